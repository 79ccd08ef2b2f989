"""Secrets in text by linking the parts of a credential.

Strong parts (an assigned secret, an access key id, a long hexadecimal string) are reported as they are. Weak parts (an
opaque word, a short hexadecimal string, a named client, an endpoint) are common in clean text, so each is reported
only where the parts that complete it lie in its scope: a secret needs an access identifier or an endpoint, a client
needs a secret, and an endpoint needs both a secret and an access identifier, with at most `scope` code points between the end of the earlier part and
the start of the later one.

The scope is an interval join: text is cut into cells of `scope` code points, each part tells the cells it covers and
the two beside them where it is, first and last places are kept for each (document, cell, role), and a candidate meets
the rows of the cells it covers. A document with many parts is as many rows, and one for each cell of a long part,
never pairs.

Defined cases: null and empty texts have no part; repeated rows are scanned each; an empty table gives no row; null ids
are carried through; columns of any name pass through in `doc`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .staging import staged

# The base patterns. They match what the plain definitions match, written for a linear search.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
# The patterns of weak parts.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+"
VALUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?!=[\"']?[A-Za-z0-9+/_-])"
# A key in letters of one case: a stretch without slashes, so that a dated path is none.
ONE_CASE = "(?<![A-Za-z0-9+_-])(?=[A-Za-z+_-]*+[0-9][A-Za-z+_-]*+[0-9])(?=[0-9+_-]*+[A-Za-z])[A-Za-z0-9+_-]{16,}+"
SHORT_HEX = "(?<![0-9A-Za-z])[0-9a-f]{16,23}(?![0-9A-Za-z])"
CLIENT = r"""(?i:client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
NAMED = rf"(?:{CLIENT})(?![+/])"
ENDPOINT = r"""(?i:https?|ftp|ssh|jdbc:[a-z]{2,12}|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]++"""

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "secret", "short_hex", "client", "endpoint")
#: Role of each kind, and the roles that a weak kind needs in scope (any of the groups, all of a group).
ROLE = {"assign": "secret", "access": "access", "hex": "secret", "secret": "secret", "short_hex": "secret", "client": "access", "endpoint": "endpoint"}
ROLES = ("secret", "access", "endpoint")
NEEDS = {"secret": (("access",), ("endpoint",)), "short_hex": (("access",), ("endpoint",)), "client": (("secret",),), "endpoint": (("secret", "access"),)}


def _parts(text: Column) -> Column:
    """(kind, start, end) of every part, strong and weak."""
    def mixed(s):
        return s["match"].rlike("[0-9].*[0-9]") & s["match"].rlike("[A-Z]") & s["match"].rlike("[a-z]")

    patterns = {
        "assign": (ASSIGN, text.contains("=") | text.contains(":"), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6),
        "access": (ACCESS, text.contains("AKIA"), lambda s: F.length(s["match"]) >= 20),
        "hex": (HEX, text.rlike("[0-9a-f]{24}"), None),
        "secret": (OPAQUE, text.rlike("[0-9]"), mixed),
        "short_hex": (SHORT_HEX, text.rlike("[0-9a-f]{16}"), lambda s: s["match"].rlike("[0-9].*[0-9]")),
        "client": (CLIENT, text.contains("=") | text.contains(":"), None),
        "endpoint": (ENDPOINT, text.contains("://"), None),
    }
    # Words after "=" too. A client's name or an access id is no secret of its own, or it would be its own complement.
    values = (f"{NAMED}|{VALUE}", text.rlike("[0-9]"), lambda s: (mixed(s) | s["match"].rlike(ONE_CASE)) & ~s["match"].rlike(f"^{NAMED}|AKIA[A-Z0-9]{{16}}|^[0-9a-f]{{16,23}}$"))

    def found(pattern, only_if, fits):
        all_of = S.matches(text, pattern, only_if)
        return F.filter(all_of, fits) if fits else all_of

    def of(kind):
        if kind != "secret":
            return F.transform(found(*patterns[kind]), lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        place = [F.transform(found(*p), lambda s: F.shiftleft(s["start"].cast("long"), 32) + s["end"]) for p in (patterns["secret"], values)]
        return F.transform(F.array_union(*place), lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.shiftright(x, 32).cast("int").alias("start"),
                                                                      x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("end")))

    return F.concat(*[of(k) for k in KINDS])


def parts(docs: DataFrame, text: str = "text", doc_columns: tuple[str, ...] | None = None) -> DataFrame:
    """doc, uid and parts of every row; staged."""
    found = _parts(F.coalesce(F.col("body"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in doc_columns or docs.columns]).alias("doc"), docs[text].alias("body"),
                       F.monotonically_increasing_id().alias("uid"))
    return staged(rows.select("doc", "uid", found.alias("parts")), "parts")


def linked(found: DataFrame, scope: int = 400) -> DataFrame:
    """uid and linked: the weak parts whose complement is in scope."""
    role = F.element_at(F.array(*[F.lit(ROLES.index(ROLE[k])) for k in KINDS]), F.col("part.kind") + 1)
    cell_of = lambda place: F.floor(F.col(place) / scope).cast("int")
    each = found.select("uid", F.explode("parts").alias("part")).withColumn("role", role)
    start, end = F.col("part.start"), F.col("part.end")
    covered = each.withColumn("first", cell_of("part.start")).withColumn("last", cell_of("part.end"))
    seen = covered.withColumn("cell", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)))
    after, before = F.col("cell") < F.col("first"), F.col("cell") > F.col("last")
    cells = seen.groupBy("uid", "cell").agg(*[a for i, r in enumerate(ROLES) for a in (
        F.max(F.when((F.col("role") == i) & before, end)).alias(f"{r}_before"),
        F.max((F.col("role") == i) & ~before & ~after).alias(f"{r}_here"),
        F.min(F.when((F.col("role") == i) & after, start)).alias(f"{r}_after"))])

    def near(r: str) -> Column:
        return F.max(F.col(f"{r}_here") | F.coalesce(start - F.col(f"{r}_before") <= scope, F.lit(False))
                     | F.coalesce(F.col(f"{r}_after") - end <= scope, F.lit(False))).alias(r)

    weak = (covered.where(F.col("part.kind") >= len(BASE_KINDS)).withColumn("cell", F.explode(F.sequence("first", "last"))).join(cells, ["uid", "cell"])
            .groupBy("uid", "part").agg(*[near(r) for r in ROLES]))
    complete = F.lit(False)
    for kind, groups in NEEDS.items():
        for group in groups:
            needed = F.col("part.kind") == KINDS.index(kind)
            for r in group:
                needed = needed & F.col(r)
            complete = complete | needed
    return weak.where(complete).groupBy("uid").agg(F.collect_list("part").alias("linked"))  # of one document


def _by_place(spans: Column) -> Column:
    """By start, then kind as listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text: str = "text", doc_columns: tuple[str, ...] | None = None, scope: int = 400) -> DataFrame:
    """doc, base (strong parts) and linked (weak parts with their complement in scope), arrays of (kind, start, end)."""
    found = parts(docs, text, doc_columns)
    base = F.filter("parts", lambda s: s["kind"] < len(BASE_KINDS))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def free(s, strong):
        return ~F.exists(strong, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    weak = F.filter(F.coalesce("linked", none), lambda s: free(s, F.col("base")))
    return (found.join(linked(found, scope), "uid", "left").withColumn("base", base).select("doc", "base", weak.alias("linked")))


def secrets_report(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    rows = secret_spans(docs, doc_columns=(doc_id,))

    def number(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    return rows.select(F.col(f"doc.{doc_id}").alias("doc_id"), *[number(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
                       F.sha2(_by_place(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       _by_place(F.concat("base", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))
