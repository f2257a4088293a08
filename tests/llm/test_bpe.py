import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reflume.llm import bpe
from reflume.llm.queries import tokenizer

from .cases import documents, none

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def texts():
    rng = random.Random(1)
    letters = [*"abcdefstrvmlld''''''   \n\t\r éÉßΣσςİǅ日本語ñ½²12345٣!?%$-_<|>🙂", "\u0085", "é", "\x00", "\x1c"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x10000, 0x1FFFF), 32])) for _ in range(40)) for _ in range(300)]
    return [*made, None, "", "<|endoftext|>a <|endoftext|><|endoftext|>", "x<|startoftext|> y<|endoftext|", "a" * 5000 + " " * 3000 + "!" * 700, "they're don't 's's ''s !!'s  's 'S we'Ve", "\n\n a\n"]


@pytest.mark.parametrize("name", FILES)
def test_equals_the_library(name):
    own, library = bpe.Coder(tokenizer(name)), Tokenizer.from_file(tokenizer(name))
    given = texts()
    ids = own.encode(given)
    assert [x.tolist() for x in ids] == [library.encode(t or "", add_special_tokens=False).ids for t in given]
    if name == FILES[0]:
        assert own.decode(ids) == [t or "" for t in given]
        assert own.decode([np.array([50256, 220, 136])]) == [library.decode([50256, 220, 136], skip_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_trees_side_by_side_equal_one_tree(name):
    own, rng = bpe.Coder(tokenizer(name)), random.Random(2)
    words = [bytes(rng.choice(b"theranionst") for _ in range(rng.randint(1, 130))) for _ in range(400)]
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    ids, counts = own.words_to_ids(data, np.cumsum(sizes) - sizes, sizes)
    alone = [own.merge_long([*own.first[list(w[:-1])].tolist(), int(own.last[w[-1]])]) for w in words]
    assert ids.tolist() == [i for a in alone for i in a] and counts.tolist() == [len(a) for a in alone]


def test_forgetting_changes_nothing(monkeypatch):
    own, given = bpe.Coder(tokenizer(FILES[0])), texts()[:300]
    wanted = [x.tolist() for x in own.encode(given)]
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    assert [x.tolist() for x in own.encode(given)] == wanted


def test_frames_round_trip(spark):
    docs, path = documents(spark), tokenizer(FILES[0])
    back = bpe.decode(bpe.encode(docs, path), path)
    assert set(back.columns) == {*docs.columns, "decoded"}
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0 and back.count() == docs.count()
    library = Tokenizer.from_file(path)

    def wanted(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    found = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path).collect()), key=repr)
    assert found == sorted(((r.doc_id, *wanted(r.text)) for r in docs.collect()), key=repr)
    assert bpe.digests(none(spark), path).count() == 0
