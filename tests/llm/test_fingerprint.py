import hashlib

import numpy as np

from reflume.llm import fingerprint as fp

from .cases import LONG, PROSE, documents, none


def naive_starts(data: bytes) -> list[int]:
    """Boundaries byte by byte."""
    starts, start, h = [0], 0, 0
    for i, b in enumerate(data):
        h = (h * 2 + int(fp._GEAR[b])) % 2**32
        size = i + 1 - start
        loose, strict = h >> (32 - fp.LOOSE_BITS) == 0, h >> (32 - fp.STRICT_BITS) == 0
        if size == fp.MOST or (size >= fp.LEAST and (strict if size < fp.NORMAL else loose)):
            start = i + 1
            starts.append(start)
    return [s for s in starts if s < len(data)]


def test_boundaries_equal_a_rolling_hash():
    for text in (LONG[:5000].encode(), b"a" * 1000, bytes(range(256)) * 9, b"x" * 8, b"abc"):
        assert fp.boundaries(np.frombuffer(text, np.uint8)) == naive_starts(text)


def test_containment_survives_shifts_and_measures_shares():
    text = LONG.encode()
    a, b = fp.chunk_weights(text), fp.chunk_weights(b"put in front " + text)
    assert fp.containment(a, b) > 0.98
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    other = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    for share in (0.25, 0.5, 0.75):
        cut = int(len(base) * share)
        assert abs(fp.containment(fp.chunk_weights(base), fp.chunk_weights(base[:cut] + other[cut:])) - share) < 0.02
    assert fp.containment(fp.chunk_weights(b""), fp.chunk_weights(b"")) == 1.0
    assert fp.containment(fp.chunk_weights(b""), a) == fp.containment(a, fp.chunk_weights(b"")) == 0.0


def test_pack_round_trip():
    weights = fp.chunk_weights(LONG.encode())
    again = fp.unpack(fp.pack(weights))
    assert (again[0] == weights[0]).all() and (again[1] == weights[1]).all() and weights[1].sum() == len(LONG.encode())


def test_query_against_a_loop(spark):
    docs = documents(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1]))
    wanted = []
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.pack(fp.chunk_weights(t.encode())), fp.containment(fp.chunk_weights(t.encode()), fp.chunk_weights(following.encode()))))
    found = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in fp.neighbour_likeness(docs).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert fp.neighbour_likeness(none(spark)).count() == 0
    one = fp.neighbour_likeness(docs.where("doc_id = 10")).first()
    assert (one.near_edited, one.near_next) == (1.0, 1.0)


def test_equal_texts_have_equal_fingerprints(spark):
    made = {r.doc_id: r.fingerprint for r in fp.fingerprints(documents(spark)).collect()}
    assert made[0] == made[1] != made[2] and made[3] == made[4] == "" and len(PROSE) > 8


def chunks(data):
    """Bytes of each chunk of a text by the rolling hash, with how many bytes all its copies cover."""
    if not data:
        return {}
    starts, weights = naive_starts(data), {}
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        weights[data[a:b]] = weights.get(data[a:b], 0) + b - a
    return weights


def likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum(min(w, b.get(c, 0)) for c, w in a.items()) / sum(a.values())


def test_the_query_equals_chunks_of_bytes(spark):
    """Both fingerprints' weights and both likenesses of every row, from the chunks' bytes."""
    texts = [LONG[:4000], LONG[1000:6000], PROSE * 30, "", None, PROSE * 30 + LONG[:300], "ab" * 700, "é🙂" * 90, "x"]
    rows = [(n * 3, t) for n, t in enumerate(texts)]
    order = sorted(rows, key=lambda r: -r[0])
    found = {r.doc_id: r for r in fp.neighbour_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(found) == len(rows)
    for n, (i, t) in enumerate(order):
        own, following = t or "", order[(n + 1) % len(order)][1] or ""
        edited = own[: len(own) - len(own) // 3] + following[: len(own) // 3]
        a, b, c = (chunks(x.encode()) for x in (own, edited, following))
        r = found[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(own)
        assert sorted(fp.unpack(r.fingerprint)[1].tolist()) == sorted(a.values()) and sorted(fp.unpack(r.edited_fingerprint)[1].tolist()) == sorted(b.values())
        assert abs(r.near_edited - likeness(a, b)) < 1e-12 and abs(r.near_next - likeness(a, c)) < 1e-12
