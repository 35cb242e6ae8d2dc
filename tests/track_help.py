"""Fixed values and helpers of the track tests."""

import hashlib

import numpy as np

DIM = 5
FRAMES = (10, 11, 13, 14, 16, 17, 18)
MISSING_FRAME = 11
#: Settings under which small groups take the plan of hot ones.
HOT = {"hot_rows": 50, "chunk_rows": 32}


def extractor(key):
    """A vector drawn from the digest of the key, so any change of the key changes it."""
    digest = hashlib.sha256(key.encode()).digest()
    return np.frombuffer(digest[:DIM], dtype=np.uint8).astype(np.float32) / 16
