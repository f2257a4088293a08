import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from reflume.llm import piecebpe
from reflume.llm.queries import op12_sentencepiece_encoding_decoding, tokenizer

from .cases import documents, none

FILE = "piece_bpe_32k.model"


def texts():
    rng = random.Random(3)
    letters = [*"abcdefstheringon    ▁\n\t\r éÉßΣσςİ日本語の中國ñ½²12345!?%$-_<|>🙂", "\u0085", "\x00", "　", "é"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x10000, 0x1FFFF), 32])) for _ in range(40)) for _ in range(300)]
    made += ["".join(rng.choice("theanioren") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    return [*made, None, "", " ", "  ", "▁", "▁ ▁a", "a" * 5000 + " " * 3000 + "!" * 700, "<s>a</s><unk><0x41>", " a", "a ", "日本語" * 400, "\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer(FILE))


def test_equals_the_library(library):
    own, given = piecebpe.Coder(tokenizer(FILE)), texts()
    ids = own.encode(given)
    want = [library.encode(t or "") for t in given]
    assert [x.tolist() for x in ids] == want
    assert own.decode(ids) == [library.decode(x) for x in want]


def test_decodes_any_ids_as_the_library(library):
    own, rng = piecebpe.Coder(tokenizer(FILE)), random.Random(5)
    some = [*range(300), 29871, 31000, 31999]
    lists = [[rng.choice(some) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    assert own.decode([np.array(x, np.int64) for x in lists]) == [library.decode(x) for x in lists]


def test_side_by_side_equals_one_heap():
    own, rng = piecebpe.Coder(tokenizer(FILE)), random.Random(2)
    words = ["▁" * rng.randint(0, 17) + "".join(rng.choice("therandionst日é") for _ in range(rng.randint(1, 150))) for _ in range(600)]
    text = piecebpe.code_points("".join(words))
    sizes = np.array([len(w) for w in words])
    symbols = own.single[text].astype(np.int64)
    here = own.agendas(symbols, sizes)
    alone = [own.agenda_of_one(own.single[piecebpe.code_points(w)].tolist())[0] for w in words]
    assert symbols[here].tolist() == [i for a in alone for i in a]


def test_forgetting_and_words_across_change_nothing(monkeypatch):
    own, given = piecebpe.Coder(tokenizer(FILE)), texts()[:300]
    wanted = [x.tolist() for x in own.encode(given)]
    for name, value in (("REMEMBERED", 5), ("AT_ONCE", 50), ("LONG", 4), ("SIDE_BY_SIDE", 3)):
        monkeypatch.setattr(piecebpe, name, value)
    assert [x.tolist() for x in own.encode(given)] == wanted
    own.words_apart = False
    own.forget()
    assert [x.tolist() for x in own.encode(given)] == wanted


def test_a_difference_to_the_library_ends_the_job():
    own = piecebpe.Coder(tokenizer(FILE))
    own.joins.clear()
    own.pairs = piecebpe.PairRanks({})
    with pytest.raises(ValueError, match="other ids"):
        own.encode(["there is a difference"])


def test_other_vocabularies_are_refused(tmp_path):
    data = open(tokenizer(FILE), "rb").read()
    at = data.index(b"\x12", len(data) - 400)
    odd = tmp_path / "odd.model"
    odd.write_bytes(data.replace(b"\x18\x02\x20", b"\x18\x01\x20", 1) if b"\x18\x02\x20" in data else data[:at])
    with pytest.raises(ValueError, match="isn't a vocabulary"):
        piecebpe.Coder(str(odd))


def test_frames_round_trip(spark, library, tmp_path):
    docs, path = documents(spark), tokenizer(FILE)
    back = piecebpe.decode(piecebpe.encode(docs, path), path)
    assert set(back.columns) == {*docs.columns, "decoded"}
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0 and back.count() == docs.count()

    def wanted(text):
        ids = library.encode(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = op12_sentencepiece_encoding_decoding(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(((r.doc_id, *wanted(r.text)) for r in docs.collect()), key=repr)
    assert piecebpe.digests(none(spark), path).count() == 0
