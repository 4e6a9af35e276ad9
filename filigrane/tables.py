"""Fixed values and table layouts that are part of the meaning of the operators."""

# Lengths in px unless said; lambda is the unit length.
LAMBDA_PX = 11.9
CNR_REQUIRED = 3.0
CNR_VISIBLE = 1.5
CNR_OBSERVE = 3.0
MIN_RUN_PX = LAMBDA_PX
BRIDGE_PX = 0.5 * LAMBDA_PX
MERGE_BLUR_RATIO = 2.0
RECORD_BRIDGE = 3
VIS_END_ANGLE_DEG = 60.0
SHALLOW_DEG = 15.0
SYM_R = 0.85
CORE_JOIN = 0.5
JOIN_DIAM_PX = 2 * LAMBDA_PX
Z_MAX = 2.0
REACH_CLASSES = (6.0, 12.0, 24.0, 48.0, 96.0)
CNR_BINS = (0, 0.5, 1, 1.5, 2, 2.5, 3, 4, 5, 7, 10, 20, 50, 1e9)

# Resolution gap over blur, by radius over blur.
G_RES_RHO = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5)
G_RES_GAP = (2.73, 2.57, 2.38, 2.2, 2.03, 1.86, 1.7, 1.4, 1.13, 0.84, 0.59, 0.39, 0.21, 0.0)

# Background RMS per band where an image has none of its own.
DEFAULT_BAND_RMS = {
    "average": {1: 0.0005, 2: 0.0010, 4: 0.0022, 8: 0.0041, 16: 0.0063, 32: 0.0084},
    "frame": {1: 0.0041, 2: 0.0023, 4: 0.0025, 8: 0.0041, 16: 0.0063, 32: 0.0084},
}

# Closed lists of names.
CLASSES = ("capillary", "arteriole", "venule", "episcleral_artery", "episcleral_vein", "anastomosis", "perforator")

# Layout of network documents (Spark DDL).
NETWORK_DOC = (
    "format STRING, version INT, meta MAP<STRING,STRING>, "
    "nodes ARRAY<STRUCT<nid:LONG, xy:ARRAY<DOUBLE>, depth:DOUBLE, kind:STRING, pressure:DOUBLE, "
    "info:MAP<STRING,STRING>>>, "
    "vessels ARRAY<STRUCT<vid:LONG, u:LONG, v:LONG, ctrl:ARRAY<ARRAY<DOUBLE>>, r_ctrl:ARRAY<DOUBLE>, "
    "z_ctrl:ARRAY<DOUBLE>, h_ctrl:ARRAY<DOUBLE>, cls:STRING, side:STRING, flow:DOUBLE, info:MAP<STRING,STRING>>>")
