"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import op06_mix, op01_warc
from .op01_warc import op1_warc
from .op02_media import op2_media
from .op03_pack import op3_pack
from .op04_minhash import op4_minhash
from .op05_urls import op5_urls
from .op06_mix import op6_mix
from .op07_pii import op7_pii
from .op08_hnsw import op8_hnsw
from .op09_langid import op9_langid
from .op10_rlz import op10_rlz

QUERIES = {
    "op1_warc": op1_warc,
    "op2_media": op2_media,
    "op3_pack": op3_pack,
    "op4_minhash": op4_minhash,
    "op5_urls": op5_urls,
    "op6_mix": op6_mix,
    "op7_pii": op7_pii,
    "op8_hnsw": op8_hnsw,
    "op9_langid": op9_langid,
    "op10_rlz": op10_rlz,
}

ORACLES = {
    "op1_warc": op01_warc.ORACLE,
    "op6_mix": op06_mix.ORACLE,
}
