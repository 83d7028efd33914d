"""Operators on texts against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import forest, language, lengths, mixing, pieces, quality, substrings, syncmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType())])


def words_of(text):
    return WORD.findall(text or "")


def odd_texts():
    return [None, "", " \t\n", "one", "Two  words", "\x1c\x85 not white", "A" * 3000, "long " * 4000, "naïve café 漢字 😀 ▁ <s>", "x\x00y", "x\x00y"]


def corpus(seed=5, n=60):
    """Texts with shared passages, near copies and exact copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    passage, base, texts = make(60), make(120), []
    for i in range(n):
        kind = i % 6
        words = make(rnd.randint(5, 150))
        if kind == 1:
            at = rnd.randint(0, len(words))
            words = words[:at] + passage[rnd.randint(0, 5) :] + words[at:]
        elif kind == 2:
            words = base.copy()
            for _ in range(rnd.randint(0, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        elif kind == 3 and texts:
            words = words_of(rnd.choice(texts))
        elif kind == 4:
            words = make(20) * rnd.randint(2, 4)
        texts.append(rnd.choice([" ", "\n", "  \t"]).join(words))
    return texts


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, [None, "a", "b", "ç"][k % 4], "en", "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def texts():
    return odd_texts() + corpus()


# ---------------------------------------------------------------- SentencePiece


def test_pieces_equal_the_library(spark, texts):
    lib = pieces.load(MODEL).library
    got = pieces.round_trip(frame(spark, texts), MODEL, check="texts", keep_ids=True).toPandas().sort_values("doc_id")
    for text, row in zip(texts, got.to_dict("records")):
        ids = lib.encode(text or "", add_eos=True)
        assert list(row["ids"]) == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert row["kept"] == "clash"


def test_a_batch_is_encoded_in_portions(monkeypatch):
    import pyarrow as pa

    texts = [None, "", "one two " * 20, "x" * 500, "three", "naïve café", "漢字 " * 30, "four five"] * 3
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "n": list(range(len(texts)))})
    monkeypatch.setattr(pieces, "RUN_CHARS", 200)
    parts = list(pieces.portions(batch.slice(2), "text"))
    assert [n for part in parts for n in part.column(1).to_pylist()] == list(range(2, len(texts)))
    assert all(part.num_rows == 1 or sum(len((x or "").encode()) for x in part.column(0).to_pylist()) <= 200 for part in parts)
    assert len(parts) > 10


def test_pieces_encode_decode(spark, texts):
    coded = pieces.encode(frame(spark, texts).withColumn("ids", F.lit(1)), MODEL, end=False, check="stretches")
    back = pieces.decode(coded, MODEL).toPandas().sort_values("doc_id")
    lib = pieces.load(MODEL).library
    assert back["decoded"].tolist() == [lib.decode(lib.encode(t or "")) for t in texts]
    assert pieces.encode(frame(spark, []), MODEL).count() == 0


def test_both_agendas_agree():
    model = pieces.load(MODEL)
    rnd = random.Random(1)
    for n in (1, 5, 47, 48, 49, 300):
        text = "".join(rnd.choice("aabcdeè漢 the") for _ in range(n))
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        assert model.merge(marked) == model.library.encode(text)
        assert model.encode_all([text], end=False) == [model.library.encode(text)]


# ---------------------------------------------------------------- substrings


def brute_substrings(texts, n=35):
    seen = {}
    for d, text in enumerate(texts):
        w = words_of(text)
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + n))
    out = []
    for d, text in enumerate(texts):
        w = words_of(text)
        kept = [x for i, x in enumerate(w) if i not in gone[d]]
        out.append((len(w), len(gone[d]), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("group,rows", [(substrings.GROUP, substrings.ROWS), (2, 50)])
def test_substrings_equal_brute_force(spark, texts, monkeypatch, group, rows):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "ROWS", rows)
    want = brute_substrings(texts)
    df = frame(spark, texts).repartition(5)
    got = substrings.remove_repeats(df, digests=True).toPandas().sort_values("doc_id")
    assert [tuple(r) for r in got[["n_words", "n_removed", "kept_sha256"]].itertuples(index=False)] == [w[:3] for w in want]
    kept = substrings.remove_repeats(df.withColumn("doc", F.lit("mine"))).toPandas().sort_values("doc_id")
    assert [words_of(t) for t in kept["kept_text"]] == [w[3] for w in want]
    assert set(kept["doc"]) == {"mine"}


def test_substrings_null_ids_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(40))
    got = substrings.remove_repeats(frame(spark, [text, text, "other"], [None, None, None]), digests=True).toPandas()
    assert sorted(got["n_removed"]) == [0, 40, 40]
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("keys", [1, 3])
def test_substrings_with_shared_document_keys(spark, texts, monkeypatch, keys):
    whole = substrings._hashes
    few = lambda doc_id, text: (F.pmod(whole(doc_id, text)[0], F.lit(keys)), whole(doc_id, text)[1])
    monkeypatch.setattr(substrings, "_hashes", few)
    got = substrings.remove_repeats(frame(spark, texts), digests=True).toPandas().sort_values("doc_id")
    want = brute_substrings(texts)
    assert [tuple(r) for r in got[["n_words", "n_removed", "kept_sha256"]].itertuples(index=False)] == [w[:3] for w in want]
    keyed = substrings.with_doc_key(frame(spark, texts), "doc_id", "text")
    assert keyed.select("_doc").distinct().count() == keyed.select("doc_id", "text").distinct().count()


def test_joined_windows():
    got = substrings.joined(np.array([2, 1, 1, 1, 2, 1]), np.array([5, 3, 1, 2, 6, 9]))
    assert list(zip(*(got[k].tolist() for k in ("doc", "start", "size")))) == [(1, 1, 3), (1, 9, 1), (2, 5, 2)]
    assert not len(substrings.joined(np.zeros(0, np.int64), np.zeros(0, np.int64))["doc"])


def test_leftmost_least():
    values = np.random.default_rng(3).integers(0, 4, 60)
    for width in (1, 2, 7, 28):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert substrings.leftmost_least(values, width).tolist() == want


# ---------------------------------------------------------------- near duplicates


def brute_components(texts, ids):
    sets = []
    for text in texts:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block,best", [(forest.BLOCK, forest.FIRST_BEST), (3, 1)])
def test_components_equal_brute_force(spark, texts, monkeypatch, block, best):
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "FIRST_BEST", best)
    ids = [7 * i % 1009 for i in range(len(texts))]
    want = brute_components(texts, ids)
    got = forest.components(frame(spark, texts, ids).repartition(4)).toPandas().set_index("id").loc[ids]
    assert list(zip(got["n_shingles"], got["component_id"])) == want
    assert got["kept"].tolist() == [i == c for i, (_, c) in zip(ids, want)]


@pytest.mark.parametrize("block,sketch", [(forest.BLOCK, forest.SKETCH), (3, forest.SKETCH), (forest.BLOCK, 20), (4, 20)])
def test_completion_alone_equals_brute_force(spark, texts, monkeypatch, block, sketch):
    """No neighbour pair is confirmed first, so only the completion links, in every tree; short sketches leave all to the full sets."""
    monkeypatch.setattr(forest, "SKETCH", sketch)
    if sketch < forest.VALUES:
        monkeypatch.setattr(forest, "SKETCH_ESTIMATE", 0.3)
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "FIRST_BEST", 0)
    rnd = random.Random(11)
    base = [f"v{rnd.randint(0, 999)}" for _ in range(100)]
    alike = [" ".join(base[:i] + [f"new{i}"] + base[i + 1 :]) for i in range(0, 100, 4)]
    some = texts + alike
    ids = [7 * i % 1009 for i in range(len(some))]
    got = forest.components(frame(spark, some, ids).repartition(4)).toPandas().set_index("id").loc[ids]
    assert list(zip(got["n_shingles"], got["component_id"])) == brute_components(some, ids)


def test_keep_one(spark, texts):
    ids = list(range(len(texts)))
    want = {c for (n, c) in brute_components(texts, ids) if n} | {i for i, t in enumerate(texts) if not words_of(t)}
    kept = forest.keep_one(frame(spark, texts, ids))
    assert kept.columns == DOC.names
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    twice = frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, None], [3, 3, None, None, 5])
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in forest.keep_one(twice).collect()) == [(False, 3), (False, 5), (True, 0)]
    assert forest.components(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- language


def test_language(spark):
    rnd = random.Random(2)
    letters = {"xx": "abcde", "yy": "vwxyzß"}
    rows = [(i, " ".join("".join(rnd.choice(letters[k]) for _ in range(5)) for _ in range(rnd.randint(1, 120))), "s", k, "", "") for i in range(300) for k in [("xx", "yy")[i % 2]]]
    odd = [(1000, None, "s", "xx", "", ""), (1001, "", "s", "yy", "", ""), (1002, "12 34 !?", "s", None, "", ""), (None, "abc ab", "s", "zz", "", ""), (1003, "abcd " * 9000, None, None, "", "")]
    docs = spark.createDataFrame(rows + odd, DOC)
    net = language.train(docs)
    assert net.languages == ["xx", "yy"]  # never from null ids
    got = language.predict(docs.withColumn("score", F.lit("clash")).withColumn("held", language.held_out()), net).toPandas()
    plain = got[got["doc_id"] < 1000]
    held = plain[plain["held"]]
    assert len(held) > 50 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    by_id = got.set_index("doc_id")
    assert by_id.loc[[1000, 1001, 1002], "lang_pred"].tolist() == ["und"] * 3 and by_id.loc[1003, "lang_pred"] == "xx"
    assert got["score"].between(0, 1).all()
    assert got[got["doc_id"].isna()]["held"].all()
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.train(none) is None
    assert {r["lang_pred"] for r in language.predict(none, None).collect()} == {"und"}


def test_gradients_are_slopes():
    net = language.Network.fresh(["a", "b"], 3)
    for name in ("embed", "filters", "bias", "dense", "dense_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 256, (4, language.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(language.softmax(net.pooled(net.columns(x).astype(np.float64))[0] @ net.dense + net.dense_bias)[np.arange(4), y]).mean()
    for g, name in zip(net.gradients(x, y, net.mask()), ("embed", "filters", "bias", "dense", "dense_bias")):
        p = getattr(net, name)
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        step, before = 1e-3, p[i]
        p[i] = before + step
        up = loss()
        p[i] = before - step
        slope = (up - loss()) / (2 * step)
        p[i] = before
        assert abs(slope - g[i]) < 0.05 * abs(g[i]) + 1e-4


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, fixed = sum(sizes.values()), {}, set()
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            break
        free = total - sum(most * sizes[s] for s in fixed)
        out = {s: free * w[s] / sum(w[x] for x in rest) for s in rest}
        above = {s for s in rest if out[s] >= most * sizes[s]}
        if not above:
            break
        fixed |= above
    return {s: out.get(s, most * sizes[s]) if s not in fixed else most * sizes[s] for s in names}


def test_mix(spark, texts):
    df = frame(spark, texts * 3, list(range(3 * len(texts))))
    got = mixing.mix(df).toPandas()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert len(got) == 3 * len(texts) and (got["kept"] == "clash").all()
    sizes = {}
    for text, source in zip(got["text"], got["source"]):
        key = source if isinstance(source, str) else None
        sizes[key] = sizes.get(key, 0) + len(words_of(text))
    want = brute_targets(sizes)
    for source, group in got.groupby(got["source"].map(lambda s: s if isinstance(s, str) else ""), dropna=False):
        key = source or None
        assert (group["size"] == [len(words_of(t)) for t in group["text"]]).all()
        assert (group["source_size"] == sizes[key]).all() and np.allclose(group["target"], want[key])
        assert (group["taken"] <= 3 * group["size"]).all()
        assert abs(group["taken"].sum() - want[key]) <= 20
    times = mixing.repeated(mixing.mix(df), df.columns)
    assert times.columns == df.columns and times.count() == int((got["taken"] / got["size"].clip(lower=1)).sum())
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["target"] for r in mixing.mix(frame(spark, [None, ""])).collect()] == [0.0, 0.0]


def test_mix_takes_nothing_above_every_limit(spark):
    docs = frame(spark, ["a b c"])
    row = mixing.mix(docs).first()
    assert (row["target"], row["taken"]) == (3.0, 3)


def test_fit_finds_reachable_sums():
    """Also where documents are longer than the program's least span, and within one document's length of large budgets."""
    assert int((mixing.fit(np.array([50_000, 70_000, 90_000]), np.array([2, 2, 2]), 230_000) * [50_000, 70_000, 90_000]).sum()) == 230_000
    rnd = random.Random(12)
    for _ in range(60):
        lengths = np.array(sorted(rnd.sample(range(1, rnd.choice([40, 60_000])), rnd.randint(1, 6))))
        counts = np.array([rnd.randint(1, 3) for _ in lengths])
        total = int((lengths * counts).sum())
        budget = rnd.randint(0, total)
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = mixing.fit(lengths, counts, budget)
        assert (used >= 0).all() and (used <= counts).all()
        if budget <= mixing.SPAN_DOCS * lengths.max():
            assert int((used * lengths).sum()) == max(s for s in sums if s <= budget)
    lengths, counts = np.arange(1, 400), np.full(399, 50)
    for budget in (100_001, 2_345_678, 3_989_999):
        used = mixing.fit(lengths, counts, budget)
        assert int((used * lengths).sum()) == budget and (used <= counts).all()


def test_knapsack_is_exact():
    rnd = random.Random(4)
    for _ in range(60):
        sizes = np.array(sorted(rnd.sample(range(1, 60), rnd.randint(1, 7))))
        free = np.array([rnd.randint(0, 4) for _ in sizes])
        budget = rnd.randint(0, 250)
        sums = {0}
        for size, n in zip(sizes.tolist(), free.tolist()):
            sums = {s + size * k for s in sums for k in range(n + 1)}
        used = mixing.knapsack(sizes, free, budget)
        assert (used <= free).all() and (used * sizes).sum() == max(s for s in sums if s <= budget)


# ---------------------------------------------------------------- lengths


def test_length_histogram(spark, texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = lengths._encoding(path)
    assert isinstance(encoding, tiktoken.Encoding)
    n = sorted(len(encoding.encode_ordinary(t or "")) for t in texts)
    hist = lengths.histogram(lengths.token_lengths(frame(spark, texts), path))
    rows = {r["n_tokens"]: r for r in hist.collect()}
    assert set(rows) == set(n)
    for limit, row in rows.items():
        assert row["n_docs"] == n.count(limit)
        assert row["docs_at_least"] == sum(x >= limit for x in n) and row["tokens_at_least"] == sum(x for x in n if x >= limit)
        assert (row["docs_total"], row["tokens_total"]) == (len(n), sum(n))
        assert row["tokens_truncated"] == sum(min(x, limit) for x in n)
        assert (row["rank_from"], row["rank_to"]) == (n.index(limit) + 1, n.index(limit) + n.count(limit))
    limits = spark.createDataFrame([(0,), (1,), (64,), (10**6,)], "context long")
    for row in lengths.at_limits(hist, limits).collect():
        c = row["context"]
        assert tuple(row)[1:] == (sum(x <= c for x in n), sum(x for x in n if x <= c), sum(min(x, c) for x in n))
    assert hist.agg(lengths.quantile(0.5).alias("q")).first()["q"] == n[-(-len(n) // 2) - 1]
    assert lengths.histogram(lengths.token_lengths(frame(spark, []), path)).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(spark, texts):
    spark_rows = syncmers.edited_fingerprints(frame(spark, texts).repartition(6)).toPandas().sort_values("doc_id")
    plain = [t or "" for t in texts]
    for i, row in enumerate(spark_rows.to_dict("records")):
        n, following = len(plain[i]), plain[(i + 1) % len(plain)]
        edited = plain[i][: n - n // 2] + following[: n // 2]
        assert (row["doc_id"], row["n_chars"]) == (i, n)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, changed = (syncmers.sketches([x.encode()])[0] for x in (plain[i], following, edited))
        assert (row["fingerprint"], row["edited_fingerprint"]) == (syncmers.hexed(own), syncmers.hexed(changed))
        assert row["near_edited"] == syncmers.likeness(own, changed) and row["near_next"] == syncmers.likeness(own, other)
        assert 0 <= row["near_edited"] <= 1
    assert syncmers.likeness(own, own) == 1


def test_fingerprint_order_with_null_and_repeated_ids(spark):
    got = syncmers.edited_fingerprints(frame(spark, ["bb", "cc", "aa", "dd"], [2, 2, None, 1])).collect()
    edited = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    # order: null aa, 1 dd, 2 bb, 2 cc
    assert edited == {(None, 2, sha("ad")), (1, 2, sha("db")), (2, 2, sha("bc")), (2, 2, sha("ca"))}
    assert syncmers.edited_fingerprints(frame(spark, [])).count() == 0
    one = syncmers.edited_fingerprints(frame(spark, ["abcd"], [9])).first()
    assert one["edited_sha256"] == sha("abab") and one["near_next"] == 1


def test_syncmers_are_free_of_context():
    rnd = random.Random(8)
    inner = "".join(rnd.choice("abcdefgh ") for _ in range(200)).encode()
    anchors = lambda x: {int(h) for h, _ in syncmers._sketch_run([x])[0]}
    assert anchors(inner) <= anchors(b"some other start " + inner) | set()


def long_text(seed, n):
    rnd = random.Random(seed)
    return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).encode()


def test_fingerprints_grow_with_the_text():
    """Sixty changed characters of 120,000 show wherever they are."""
    text = long_text(1, 120_000)
    own = syncmers.sketches([text])[0]
    assert len(own) > 20_000
    for at in range(0, 120_000, 10_000):
        other = syncmers.sketches([text[:at] + long_text(at + 2, 60) + text[at + 60 :]])[0]
        assert syncmers.hexed(other) != syncmers.hexed(own)
        assert 0.99 < syncmers.likeness(own, other) < 1


def test_likeness_counts_both_sides_of_an_insertion():
    text, more = long_text(3, 9000), long_text(4, 300)
    own = syncmers.sketches([text])[0]
    for parts in ([text[:4500], text[4500:]], [text[:3000], text[3000:6000], text[6000:]]):
        assert syncmers.likeness(own, syncmers.sketches([more.join(parts)])[0]) > 0.92
    line = b"one and the same line\n"
    assert syncmers.likeness(*syncmers.sketches([line * 50, line * 100])) < 0.7


@pytest.mark.parametrize("pairs", [0, syncmers.PAIRS, 10**9])
def test_common_equals_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(syncmers, "PAIRS", pairs)
    rnd = random.Random(6)
    for _ in range(300):
        x, y = ([rnd.randrange(rnd.choice([2, 5, 50])) for _ in range(rnd.randint(0, 40))] for _ in range(2))
        best = [0] * (len(y) + 1)
        for a in x:
            row = [0]
            for j, b in enumerate(y):
                row.append(best[j] + 1 if a == b else max(best[j + 1], row[j]))
            best = row
        assert syncmers._common(np.array(x, np.uint32), np.array(y, np.uint32)) == best[-1]


def test_network_equals_loops(spark):
    """Windows, filters, pooling, softmax and the mean over windows, written out byte by byte."""
    net = language.Network.fresh(["a", "b", "c"], 3)
    net.bias += 0.1
    texts = ["x", "naïve café", "word " * 120, "k" * 256, "z" * 257]
    got = {r["doc_id"]: r for r in language.predict(frame(spark, texts), net).collect()}
    for d, text in enumerate(texts):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, len(data), language.WINDOW):
            part = data[at : at + language.WINDOW]
            padded = list(part) + [0] * (language.WINDOW - len(part))
            hidden = []
            for f, width in enumerate(np.repeat(language.WIDTHS, language.FILTERS)):
                best = -np.inf
                for i in range(language.WINDOW):
                    value = 0.0
                    for k in range(width):
                        if i + k < language.WINDOW:
                            value += float(net.embed[padded[i + k]] @ net.filters[k * language.EMBED : (k + 1) * language.EMBED, f])
                    best = max(best, value)
                hidden.append(max(best + float(net.bias[f]), 0))
            out = np.array(hidden) @ net.dense + net.dense_bias
            out = np.exp(out - out.max())
            total += out / out.sum() * len(part)
        total /= total.sum()
        assert got[d]["lang_pred"] == net.languages[int(total.argmax())] and abs(got[d]["score"] - total.max()) < 1e-5


def test_sample_of_a_language_is_the_first_in_order(spark, monkeypatch):
    """Ranking by salts first gives the same windows as ranking a language at once."""
    monkeypatch.setattr(language.Network, "learn", lambda self, windows, labels: (windows, labels))
    df = spark.createDataFrame([(i, f"text number {i} of many", "en" if i % 7 else "fr") for i in range(900)], "doc_id long, text string, lang string")
    windows, labels = language.train(df, per_language=40)
    assert np.bincount(labels).tolist() == [40, 40]
    order = df.where(~language.held_out()).select("doc_id", "text", "lang", F.xxhash64(F.lit(11), "doc_id", "text").alias("place")).orderBy("place").collect()
    firsts = {lang: [r["text"] for r in order if r["lang"] == lang][:40] for lang in ("en", "fr")}
    for k, lang in enumerate(("en", "fr")):
        parts = {bytes(w[w > 0]).decode() for w in windows[labels == k]}
        assert all(any(p in t for t in firsts[lang]) for p in parts)


# ---------------------------------------------------------------- quality


def brute_rules(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(spark, texts):
    texts = texts + ["a b c d e f g h i j\na b c d e f g h i j\n\nq # $ < >", "one two three four five six seven eight nine ten eleven twelve"]
    df = frame(spark, texts)
    got = quality.judge(df, df.where("doc_id % 3 = 0")).toPandas().sort_values("doc_id")
    want = [brute_rules(t) for t in texts]
    assert [tuple(r) for r in got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]].itertuples(index=False)] == want
    assert not got[got["base_failed"]]["kept"].any()
    assert (got["kept"] == (~got["base_failed"] & (got["score"].round(quality.DECIMALS).fillna(0) >= got["threshold"]))).all()
    assert quality.judge(frame(spark, []), df).count() == 0
    none = quality.judge(df, df.where("false"))
    assert none.count() == len(texts) and none.where("kept = base_failed or threshold is not null").count() == 0


def test_quality_scores(spark):
    """The mean log ratio, counted by hand over the same buckets, and the threshold among the trusted scores."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    rows = [" ".join(rnd.choice(words[:20] if i % 3 else words[10:]) for _ in range(rnd.randint(11, 40))) for i in range(60)] + [None, "", "short text"]
    ids = [*range(60), None, 5, 61]
    df = frame(spark, rows, ids)
    trusted = {i for i in range(60) if i % 3}
    hashes = quality.with_words(df, "text").select("doc_id", "text", quality.ngrams().alias("g"), quality._fold("doc_id").alias("half")).collect()
    table = [(r["doc_id"], r["half"], [g % quality.BUCKETS for g in r["g"]]) for r in hashes]
    everything = [b for _, _, x in table for b in x]
    halves = [[b for i, half, x in table if i in trusted and half != k for b in x] for k in (0, 1)]
    share = lambda b, of: np.log((of.count(b) + 1) / (len(of) + quality.BUCKETS))
    want = sorted((i, np.mean([share(b, halves[half]) - share(b, everything) for b in x])) for i, half, x in table if x and i is not None)
    got = quality.judge(df, df.where(F.col("doc_id").isin(*trusted)), below=0.1).collect()
    assert np.allclose([s for _, s in want], [s for _, s in sorted((r["doc_id"], r["score"]) for r in got if r["score"] is not None and r["doc_id"] is not None)])
    scores = [round(r["score"], 4) for r in got if r["doc_id"] in trusted and not r["base_failed"]]
    assert abs(got[0]["threshold"] - np.quantile(scores, 0.1)) < 2e-4
    assert all(r["kept"] == (not r["base_failed"] and round(r["score"], 4) >= r["threshold"]) for r in got)


def test_bad_texts_are_rejected_at_every_size(spark):
    """Of documents labelled bad that no rule fails, most go at ten times the size as well; of good ones few do."""
    for size in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
        labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        told = quality.judge(docs, labels.where("quality = 1 and toxic = 0")).where("not base_failed").join(labels, "doc_id")
        kept = {(r["quality"], r["toxic"]): r["kept"] for r in told.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
        assert kept[0, 0] < 0.25 and kept[1, 0] > 0.97 and kept[1, 1] > 0.9


def test_block_hands_on_a_spanning_forest():
    """Many links between the components of a block come out as few pairs, and no component is left apart."""
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(1 << 30, 200, replace=False)).astype(np.uint32)
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(200, 10, replace=False)), rng.choice(1 << 30, 10).astype(np.uint32)])) for _ in range(60)]
    names = np.frombuffer(b"".join(i.to_bytes(16, "big") for i in range(60)), np.uint8).reshape(-1, 16)
    sig = np.tile(np.arange(forest.VALUES, dtype=np.uint32), (60, 1))
    held = np.array([*sets, None], object)[:-1]
    one = {"cls": names, "comp": names, "sig": sig, "sketch": held, "n": np.array([len(x) for x in sets]), "asks": np.ones(60, bool)}
    both = {k: np.concatenate([v, v]) for k, v in one.items()}
    both["asks"][60:] = False
    left, right = forest._ask(both, 0, forest.SKETCH, forest.SKETCH_ESTIMATE)
    assert len(left) == 59
    reach = {0}
    for _ in range(60):
        for a, b in zip(left, right):
            x, y = int.from_bytes(a.tobytes(), "big"), int.from_bytes(b.tobytes(), "big")
            if x in reach or y in reach:
                reach |= {x, y}
    assert len(reach) == 60
