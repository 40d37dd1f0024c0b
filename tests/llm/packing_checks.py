"""What packed pieces have to be, for the tests of packing and of the pipeline."""

import functools
import zlib

import numpy as np
from tokenizers import Tokenizer

from websource_audit.llm.common import default_tokenizer


@functools.cache
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def check_packing(rows, docs, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in docs:
        ids = [*ids_of(text), 1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), capacity))
        for r in pieces:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32 and len(part) == 4 * r.length
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)
