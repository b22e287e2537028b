"""Fixed values that results depend on."""

CALIBRATION_FRAMES, MONITOR_HZ, CADENCE_EPSILON = 24, 5.0, 1e-9
#: Frame admissibility: dynamic range, crushed, saturated, gradient; least share of admissible frames.
MIN_DYNAMIC_RANGE, MAX_CRUSHED, MAX_SATURATED, MIN_GRADIENT, MIN_VALID_SHARE = 30.0, 0.90, 0.50, 1.0, 0.50
AGREEMENT, MAX_SPECKLE, MIN_POPUP_SHARE, MIN_POPUP_FRAMES, ASPECT = 0.4, 0.002, 1e-4, 0.0, 1.25
#: Mask classes: 0 background, 1 tissue, 2 corner, 3 popup.
TISSUE, CORNER, POPUP = 1, 2, 3
MIN_BOX_FILL, BLACK_ABOVE, MIN_COMPONENT, MIN_RIM = 0.80, 18, 5000, 50
MIN_SUPPORT, INSET, MIN_SIDE = 0.30, 0.12, 8
BIN_SEC, MIN_ROUTED, MIN_BINS, MIN_SPAN, OCCUPANCY, QUANTILES, TAU, DOMINANCE = 1.0, 3, 2, 3.0, 0.5, (0.1, 0.9), 0.10, 0.70
MIN_SPLIT_IOU, MIN_AREA_RATIO, SPLIT_SEED, RANDOM_SPLITS = 0.95, 0.97, 20260809, 6
COMPETING_MARGIN = 0.10
DRIFT_IOU, DRIFT_PATIENCE, DRIFT_COUNT, TTL_FACTOR = 0.50, 1.0, 2, 1.5
EVIDENCE_BINS, EVIDENCE_ROWS, DRIFT_RING, ID_RING = 60, 4000, 30, 64
#: The model file: its digest, classes, channels of the first level, and the bytes of a network that may be broadcast.
MODEL_SHA256 = "df4054b8d2a22413ae232b7ea2ce01cbe70c838031167b5afb72c71ce9670713"
MODEL_CLASSES, MODEL_BASE, MODEL_BYTES = 4, 8, 64 << 20
METHODS = ("median", "quantile", "occupancy", "cluster")

#: Reason codes.
OK = "ok"
INSUFFICIENT = "insufficient_temporal_evidence"
INSUFFICIENT_SPLIT = "insufficient_split_evidence"
AMBIGUOUS = "ambiguous_pip_position"
POPUP_BLIND = "model_has_no_class3_channel"
UNSTABLE = "session_box_failed_stability"
NO_FOOTPRINT = "no_reliable_popup_footprint"
NOT_ROUTED = "overlay_without_endoscopic_content_support"
UNLOCKED = "pip_session_box_unavailable"
EXPIRED = "pip_ttl_expired"
DISABLED = "pip_disabled"
COMPETING = "competing_pip_clusters"
DRIFTED = "confirmed_drift_unlock"
VALID = "valid"
NOT_FOUR = "box_is_not_four_coordinates"
NON_FINITE = "box_has_non_finite_coordinate"
NON_INTEGER = "box_has_non_integer_coordinate"
INVERTED = "box_is_inverted_or_empty"
OUT_OF_FRAME = "box_outside_frame_bounds"
TOO_SMALL = "box_below_minimum_size"
MISMATCH = "box_frame_resolution_mismatch"
INVALID_POPUP = "invalid_popup_box"
