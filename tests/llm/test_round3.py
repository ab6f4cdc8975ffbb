"""Steps of the named methods: SimHash in the pipeline's near-duplicate stage, operator 9's table from all documents."""

import random

import numpy as np

from brindle.llm import near_copies, simhash, token_counts


def test_fingerprints_find_copies_that_no_band_does(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    text = " ".join(rng.choices(words, k=300))
    near = next(t for i in range(300) for t in [" ".join(w if j != i else "other" for j, w in enumerate(text.split()))]
        if bin(int(near_copies.fingerprint(near_copies.shingles(text)) ^ near_copies.fingerprint(near_copies.shingles(t))) & 2**64 - 1).count("1") in (1, 2))
    docs = spark.createDataFrame([(1, text), (2, near), (3, " ".join(rng.choices(words, k=300))), (4, ""), (5, None)], "doc_id long, text string")
    # no two sets share a band
    monkeypatch.setattr(near_copies, "bands", lambda sets: np.array([np.arange(20, dtype=np.uint64) + np.uint64(s[0]) for s in sets]) ^ np.array([[np.uint64(int(s.sum()))] for s in sets]))
    assert sorted(r.doc_id for r in simhash.keep_first(docs, words=5, least=0.8).collect()) == [1, 3, 4]


def test_frequent_pre_tokens_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COUNTED", 3)
    texts = ["alpha beta"] * 40 + ["gamma gamma gamma delta"] * 20 + ["epsilon" + " zeta" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = token_counts.frequent_lengths(docs, entries=3)
    assert set(got) == {" zeta", " gamma", " beta"}  # one document's, and ties in their order
    assert token_counts.frequent_lengths(docs.limit(0)) == {}


def test_words_go_to_the_library_in_lines(monkeypatch):
    """Operator 4's CPU: new words of letters aren't encoded one by one, and the ids are the library's, whatever the worker's table forgets."""
    import pyarrow as pa

    from brindle.llm import tokens

    monkeypatch.setattr(tokens, "LONGEST", 12)
    encoder = tokens.PieceEncoder("byte_bpe_50k.json", tokens.id_bytes, b"".join)
    encoder.words.limit = 40
    one_by_one, real = [], encoder._piece
    encoder._piece = encoder.cache.make = lambda piece: one_by_one.append(piece) or real(piece)
    for n in range(6):
        words = [f"{a}{b}{c}" for a in ("re", "Ünd", "xq", "łó") for b in ("gna", "ß", "Lorem" * 4) for c in ("", "ing", "é" * n, "!?")]
        texts = [" ".join(words), None, "", "one\nTwo 3 don't", " ".join(words[n:]) + "\n" + words[n], "two  spaces here"]
        ids, starts = encoder.batch_ids(pa.array(texts, pa.string()))
        want = [encoder.library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids[a:z].tolist() for a, z in zip(starts, starts[1:])] == want
        assert len(encoder.words.rows) <= 40 + len(words)
    assert not any(p.isalpha() for p in one_by_one if p not in ("two", "spaces", "here"))


def test_rounds_sort_only_what_may_be_frequent(monkeypatch):
    """Operator 4's CPU: a round over all symbols sorts the pairs of well-filled slots alone, and still none that is frequent is left."""
    from brindle.llm import grammar

    ids = (np.random.default_rng(2).zipf(1.3, 60_000) % 5000).astype(np.uint32)
    sorted_, real = [], grammar._counted
    monkeypatch.setattr(grammar, "_counted", lambda keys: sorted_.append(len(keys)) or real(keys))
    shard = grammar.compress(ids, 5000)
    assert (shard.decode() == ids).all()
    pairs = (shard.symbols[:-1].astype(np.uint64) << np.uint64(32)) | shard.symbols[1:]
    assert real(pairs)[1].max() < grammar.LEAST
    assert sorted_[0] < 30_000 and sorted_[-1] < len(shard.symbols) / 2
    # all pairs alike but of one symbol: half as many can be replaced as occur, and the bar is lowered
    runs = np.concatenate((np.zeros(2000, np.uint32), np.tile(np.array([1, 2, 3], np.uint32), 9)))
    assert (grammar.compress(runs, 4).decode() == runs).all() and len(grammar.compress(runs, 4).symbols) < 100
