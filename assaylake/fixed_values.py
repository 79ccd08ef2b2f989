"""Constants, lookup tables, texts and formats that results depend on."""

# --- hash chains ---------------------------------------------------------------------------
GENESIS_HASH = "0" * 64

ISSUE_MESSAGES = {
    "record_tampering": "Record hash does not match record contents.",
    "invalid_signature": "Ed25519 signature verification failed.",
    "broken_chain": "Previous-record hash does not match the preceding record.",
    "sequence_discontinuity": "Provenance sequence is discontinuous.",
    "duplicate_sequence": "Sequence number has already appeared.",
    "nonce_reuse": "Nonce has already appeared in the chain.",
}

AUDIT_ISSUE_MESSAGES = {
    "entry_tampering": "Audit entry hash does not match entry contents.",
    "broken_chain": "Previous-entry hash does not match the preceding audit entry.",
    "sequence_discontinuity": "Audit sequence is discontinuous.",
    "duplicate_sequence": "Audit sequence number has already appeared.",
    "event_id_reuse": "Audit event identifier has already appeared.",
}

MEDIUM_CHAIN_ISSUES = ("sequence_discontinuity", "nonce_reuse")

# --- severities ----------------------------------------------------------------------------
SEVERITIES = ("none", "low", "medium", "high", "critical")

# --- image files ---------------------------------------------------------------------------
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")

FORMAT_EXTENSIONS = {
    "JPEG": (".jpg", ".jpeg", ".jpe"),
    "PNG": (".png",),
    "BMP": (".bmp",),
    "TIFF": (".tif", ".tiff"),
    "WEBP": (".webp",),
}

EDITING_SOFTWARE_MARKERS = (
    "photoshop", "gimp", "lightroom", "paint.net", "affinity", "pixelmator",
    "snapseed", "canva", "imagemagick", "pillow", "opencv",
)

METADATA_ATTRIBUTES = (
    "format", "resolution", "mode", "camera", "software", "quant_hash", "has_exif",
)

ZONES = (
    ("top-left", "top-center", "top-right"),
    ("middle-left", "center", "middle-right"),
    ("bottom-left", "bottom-center", "bottom-right"),
)

# --- model files ---------------------------------------------------------------------------
EXTENSION_FORMATS = {
    ".pt": ("PyTorch checkpoint", "extension_inferred"),
    ".pth": ("PyTorch checkpoint", "extension_inferred"),
    ".torchscript": ("TorchScript", "extension_inferred"),
    ".onnx": ("ONNX", "extension_inferred"),
    ".safetensors": ("SafeTensors", "extension_inferred"),
    ".ckpt": ("Checkpoint", "extension_inferred"),
    ".pb": ("TensorFlow protobuf", "extension_inferred"),
    ".engine": ("TensorRT engine", "extension_inferred"),
    ".pkl": ("Pickle", "extension_inferred"),
    ".joblib": ("Joblib", "extension_inferred"),
    ".bin": ("generic binary", "extension_inferred_low"),
}
SAFETENSORS_MAX_HEADER = 100 * 1024 * 1024

# --- probes and trigger grid ---------------------------------------------------------------
PROBE_BATTERY = (
    ("clean", "identity", {}),
    ("horizontal_flip", "horizontal_flip", {}),
    ("brightness_decrease", "brightness", {"factor": 0.7}),
    ("brightness_increase", "brightness", {"factor": 1.3}),
    ("contrast_decrease", "contrast", {"factor": 0.6}),
    ("contrast_increase", "contrast", {"factor": 1.5}),
    ("gaussian_noise", "gaussian_noise", {"sigma": 8.0, "seed": 1337}),
    ("mild_blur", "blur", {"radius": 1.0}),
    ("small_translation", "translation", {"dx": 2, "dy": 2}),
)
TRIGGER_PATCH_SIZES = (8, 16)
TRIGGER_FRACTIONS = (0.25, 0.5, 0.75)
TRIGGER_PATTERNS = ("black", "white", "mean", "checkerboard")

# --- shift features ------------------------------------------------------------------------
SHIFT_FEATURES = ("brightness", "contrast", "saturation", "edge_density")
SHIFT_HISTOGRAMS = ("red_hist", "green_hist", "blue_hist", "gray_hist")

# --- report and analyst views --------------------------------------------------------------
REPORT_AREAS = (
    "dataset_integrity", "model_integrity", "inference_provenance",
    "distribution_shift", "findings_and_evidence", "audit_trail",
)
REPORT_SECTIONS = {
    "executive_summary": "object",
    "asset_coverage": "object",
    "dataset_integrity": "object",
    "model_integrity": "object",
    "inference_provenance": "object",
    "distribution_shift": "object",
    "findings_and_evidence": "object",
    "audit_trail": "object",
    "recommended_actions": "array",
    "limitations": "array",
}
STATUS_LABELS = {
    "completed": "COMPLETED",
    "completed_with_errors": "COMPLETED WITH WARNINGS",
    "completed_with_warnings": "COMPLETED WITH WARNINGS",
    "running": "RUNNING",
    "queued": "QUEUED",
    "created": "QUEUED",
    "not_assessed": "NOT ASSESSED",
    "unavailable": "UNAVAILABLE",
    "error": "FAILED",
    "failed": "FAILED",
    "cancelled": "CANCELLED",
}
FINDING_COUNT_FIELDS = {
    "A2_exact_duplicates": "duplicate_group_count",
    "A3_near_duplicates": "near_duplicate_pair_count",
    "A4_ood": "potential_ood_count",
    "A5_label_consistency": "finding_count",
    "A6_contributor_risk": "finding_count",
    "A7_metadata_consistency": "image_finding_count",
    "A8_poison_trigger_forensics": "candidate_trigger_count",
}
SAMPLE_KEYS = (
    "files", "file", "file_a", "file_b", "image", "image_path", "path", "sample",
    "sample_path", "affected_file", "candidate_file", "reference_file",
)
DIGEST_FIELDS = (
    "sha256", "digest", "evidence_digest", "result_digest", "record_hash", "entry_hash",
)
AUDIT_CATEGORIES = (
    "audit", "audit_trail", "audit_integrity", "audit_chain", "provenance_integrity",
)
STATE_TRANSITIONS = {
    "CREATED": ("QUEUED", "CANCELLED"),
    "QUEUED": ("RUNNING", "CANCELLED", "FAILED"),
    "RUNNING": ("COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED", "CANCELLED"),
    "COMPLETED": (),
    "COMPLETED_WITH_WARNINGS": (),
    "FAILED": (),
    "CANCELLED": (),
}
DISPOSITIONS = ("ACCEPT", "REVIEW", "QUARANTINE")

# id, area, state
CAPABILITIES = (
    ("A1", "Dataset Integrity", "SUPPORTED"),
    ("A2", "Dataset Integrity", "SUPPORTED"),
    ("A3", "Dataset Integrity", "SUPPORTED"),
    ("A4", "Dataset Integrity", "CONDITIONAL"),
    ("A5", "Dataset Integrity", "CONDITIONAL"),
    ("A6", "Dataset Integrity", "CONDITIONAL"),
    ("A7", "Dataset Integrity", "CONDITIONAL"),
    ("A8", "Dataset Integrity", "CONDITIONAL"),
    ("B1", "Model Integrity", "SUPPORTED"),
    ("B2", "Model Integrity", "CONDITIONAL"),
    ("B3", "Model Integrity", "CONDITIONAL"),
    ("B4", "Model Integrity", "CONDITIONAL"),
    ("C1", "Provenance", "SUPPORTED"),
    ("C2", "Provenance", "SUPPORTED"),
    ("C3", "Provenance", "SUPPORTED"),
    ("C4", "Provenance", "SUPPORTED"),
    ("C5", "Provenance", "SUPPORTED"),
)
