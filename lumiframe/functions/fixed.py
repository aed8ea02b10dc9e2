"""Values fixed by the JPEG standard (ITU-T T.81) and by the API that results must equal."""

from __future__ import annotations

# Raster index of each zig-zag index (T.81 figure 5).
NATURAL_ORDER = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5,
    12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51,
    58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]

# Names of marker codes (T.81 table B.1), in the order of the codes.
MARKER_NAMES = {
    0x01: "Temporary private use",
    0xC0: "Baseline DCT",
    0xC1: "Extended sequential DCT",
    0xC2: "Progressive DCT",
    0xC3: "Lossless (sequential)",
    0xC4: "Define Huffman table(s)",
    0xC5: "Differential sequential DCT",
    0xC6: "Differential progressive DCT",
    0xC7: "Differential lossless (sequential)",
    0xC8: "Reserved for JPEG extensions",
    0xC9: "Extended sequential DCT",
    0xCA: "Progressive DCT",
    0xCB: "Lossless (sequential)",
    0xCC: "Define arithmetic coding conditioning(s)",
    0xCD: "Differential sequential DCT",
    0xCE: "Differential progressive DCT",
    0xCF: "Differential lossless (sequential)",
    **{0xD0 + k: f"Restart with modulo 8 count {k}" for k in range(8)},
    0xD8: "Start of image",
    0xD9: "End of image",
    0xDA: "Start of scan",
    0xDB: "Define quantization table(s)",
    0xDC: "Define number of lines",
    0xDD: "Define restart interval",
    0xDE: "Define hierarchical progression",
    0xDF: "Expand reference component(s)",
    **{0xE0 + k: f"Application segment {k}" for k in range(16)},
    **{0xF0 + k: f"JPEG extension {k}" for k in range(14)},
    0xFE: "Comment",
}
UNKNOWN_MARKER = "unknown marker"

# Status names and their messages.
SUCCESS, INVALID_ARGUMENT, INVALID_JPEG, NOT_SUPPORTED, INCOMPLETE = "SUCCESS", "INVALID_ARGUMENT", "INVALID_JPEG", "NOT_SUPPORTED", "INCOMPLETE_BITSTREAM"
STATUS_TEXT = {
    SUCCESS: "success",
    INVALID_ARGUMENT: "invalid argument",
    INVALID_JPEG: "invalid jpeg",
    "INTERNAL_ERROR": "internal error",
    NOT_SUPPORTED: "jpeg is not supported",
    "OUT_OF_HOST_MEMORY": "out of host memory",
    INCOMPLETE: "incomplete bitstream",
}
UNKNOWN_STATUS = "unknown status"

# Luma sampling factors (x, y) of the named chroma subsamplings.
SUBSAMPLING = {
    "444": (1, 1),
    "422": (2, 1),
    "420": (2, 2),
    "440": (1, 2),
    "411": (4, 1),
    "410": (4, 2),
    "410V": (2, 4),
    "gray": (1, 1),
}

# Fixed-point constants of the 8-point inverse DCT.
COS_1_4 = 0x5A82
SIN_1_8, COS_1_8 = 0x30FC, 0x7642
SIN_1_16, COS_1_16 = 0x063E, 0x1F63
SIN_5_16, COS_5_16 = 0x1A9B, 0x11C7

# Quantisation tables of luma and chroma at quality 50 (T.81 tables K.1 and K.2), in raster order.
LUMA_TABLE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_TABLE = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

# JFIF's weights of red, green and blue in luma, blue and red difference, times 65536.
RGB_WEIGHTS = [[19595, 38470, 7471], [-11058, -21710, 32768], [32768, -27439, -5329]]

MAX_COMPONENTS = 4
MAX_SCANS = 4
MAX_UNITS_IN_MCU = 10
SUBSEQUENCE_BYTES = 128
