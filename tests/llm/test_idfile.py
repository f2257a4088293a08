import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from reflume.llm import idfile
from reflume.llm.common import stage_path
from reflume.llm.queries import tokenizer

from .cases import documents, none


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for values in ([0], [5, 5, 5], [0, 1 << 40], [-(1 << 63), 0, (1 << 63) - 1], np.sort(rng.integers(0, 10**9, 5000)), np.arange(3000) // 7, [*range(2000), 10**12]):
        made = idfile.EliasFano.of(np.array(values, np.int64))
        assert made.get(np.arange(len(values))).tolist() == list(np.array(values).tolist())
        pick = rng.integers(0, len(values), 50)
        assert made.get(pick).tolist() == np.array(values, np.int64)[pick].tolist()
    assert idfile.EliasFano.of(np.empty(0, np.int64)).get(np.arange(0)).tolist() == []


def test_space_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(2).integers(1, 2000, 50_000))
    made = idfile.EliasFano.of(ends)
    assert (len(made.low) + len(made.high)) * 8 / len(ends) <= 2.1 + np.log2(ends[-1] / len(ends)) + 1


def test_files_round_trip(spark):
    docs, path = documents(spark), tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    wanted, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.text or "")):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    shards = idfile.write(docs, stage_path(spark, "ids"), path)
    found = [tuple(r) for r in idfile.read(spark, shards, at_once=64).collect()]
    assert sorted(found, key=lambda r: r[1]) == wanted
    assert sum(s.documents for s in shards) == docs.count() and shards[-1].start + shards[-1].ids == start
    assert idfile.read(spark, idfile.write(none(spark), stage_path(spark, "ids"), path)).count() == 0


def test_parts_of_long_texts_have_the_ids_of_the_whole(monkeypatch):
    monkeypatch.setattr(idfile, "AT_ONCE", 40)
    texts = [("It's  a <|endoftext|>test,\n\n with Ünïcödé\u00a0and 12 34  words; we'll see e\u0301 \u0301x. " * 30), "x" * 500, "", None, "a b", " " * 200 + "z", "one " * 100]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own = Tokenizer.from_file(tokenizer(name))
        wanted = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
        found = list(idfile.encoded(idfile.library(tokenizer(name)), pa.array(texts)))
        assert [x.tolist() for x in found] == wanted
        assert list(idfile.encoded(idfile.library(tokenizer(name)), pa.array([], pa.string()))) == []


def test_folders_without_a_scheme(spark, tmp_path):
    shards = idfile.write(documents(spark), str(tmp_path / "ids"), tokenizer("word_bpe_49k.json"))
    assert all(s.path.startswith("file:") for s in shards) and idfile.read(spark, shards).count() == documents(spark).count()


def test_remembered_pieces_keep_their_ids(monkeypatch):
    """Over many calls whose pieces are new, known, odd or empty, and with little room; what was remembered isn't copied by every call."""
    from public_tokenizers import path

    own = idfile.library(path("word_bpe_49k.json"))
    own.forget()
    texts = [f"w{i} a{i % 7}  {own.part if i % 11 == 0 else ''}x{i * i} é{i % 5}\n{'' if i % 3 else own.part + 'q'}" for i in range(300)] + ["", " ", "\n"]
    for remembered in (idfile.REMEMBERED, 20):
        monkeypatch.setattr(idfile, "REMEMBERED", remembered)
        for some in (texts[:5], texts[3:200], texts[150:], texts[:5]):
            assert [x.tolist() for x in own.some(some)] == [own.ids(t) for t in some]
    monkeypatch.setattr(idfile, "REMEMBERED", 10_000)
    pools = []
    for i in range(500):
        own.some([f"new{i}"])
        pools.append(own.pool)
    assert len({id(p) for p in pools}) < 20
