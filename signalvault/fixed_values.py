"""They decide results, so they are stated once, here, as they are."""

# Line shapes of a signal catalog, a shot list and a rename mapping.
TREE_HEADER = r"^  [a-zA-Z0-9_]+:$"
SIGNAL_ITEM = "    - "
SERVER_LINE = "server:"
COMMENT_MARK = "#"
MAPPING_TOKENS = 2

# Plan sizes.
CHUNK_SIZE = 100
BATCH_SIZE = 1000

# Comparison of floating values: |a - b| <= ATOL + RTOL * |b|.
RTOL = 1e-9
ATOL = 1e-9
SHOWN_DIFFERENCES = 5
ONLY_IN_FIRST = "Only in first"
ONLY_IN_SECOND = "Only in second"
SHAPE_MISMATCH = "Shape mismatch"
NAN_POSITIONS = "NaN positions differ"
DATA_VALUES = "Data values differ"
ATTRIBUTE_KEYS = "Attribute keys differ"

# File names and the transfer log.
OUTPUT_SUFFIX = ".h5"
CONFIG_SUFFIX = ".yaml"
SCRATCH_PREFIX = "/cscratch/"
CHUNK_LABEL = "config_%s_%s_chunk%d_%s_%s.yml"
TRANSFER_LABEL = "Auto-transfer "
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
LABEL_TIME_FORMAT = "yyyyMMdd-HHmmss"
LOG_SEPARATOR = " | "
TRANSFER_STATUS = "TRANSFERRED_AND_DELETED"

# Ledger states.
COMPLETED = "completed"
FAILED = "failed"
CLEARED = "cleared"
