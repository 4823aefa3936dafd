import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from filigree.llm import packing
from tests.llm.helpers import frame, odd_rows, prose

PATH = packing.default_tokenizer()


def test_pieces_hold_every_id_once(spark):
    rows = odd_rows() + [(100 + k, prose(600 + k, 400)) for k in range(30)] + [(200, "It's <|endoftext|> here ​  x\r\n\n\t ñandú 12345 ١٢٣ 漢字 🙂🙂")]
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    got = packing.pack_documents(frame(spark, rows), PATH, with_ids=True).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        copies = sum(1 for j, t in rows if j == i)
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for j, t in rows if j == i)
        if copies == 1:
            assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist() == ids
            assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids) for r in pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1]) and sum(n for _, n in parts) <= 2048


def test_windows_are_nearly_equal_and_fit():
    r = random.Random(4)
    lengths = [r.randint(1, 512) for _ in range(700)]
    windows = packing.fill_windows(lengths, 2048)
    sums = [sum(lengths[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(700)) and max(sums) <= 2048
    assert 1 - sum(sums) / (2048 * len(sums)) < 0.02 and max(sums) - min(sums) < 64
    assert packing.fill_windows([], 10) == [] and sorted(packing.fill_windows([10, 10, 10], 10)) == [[0], [1], [2]]
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]  # the differencing method's own answer


def test_no_documents(spark):
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0
