"""Scores, verdicts, digests and pipeline stages beside plain versions of them; rates of success where there is no exact one."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import bbit_minhash, binary_packing, fit_packing, frames, isolation_rules, language_id, neighbour_quality, template_leaks, weak_toxicity
from test_llm import ODD, SF, brute_components, encoded

LONG = "the quick idiot and the lazy dog went home again " * 1400  # over 60,000 characters


@pytest.fixture(scope="module")
def docs(spark):
    return frames.table(spark, SF, "documents")


def sampled(spark, make, rows):
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return frames.bounded_sample(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int"), 10, make)


def test_long_labelled_texts_are_used_whole(spark):
    rows = [(1, LONG, 1), (2, "short", 0), (3, None, 0), (4, "", 1)]
    assert len(LONG) > 60_000
    got = {i: f for i, f, _ in sampled(spark, lambda: bytes, rows)}
    assert got == {1: LONG.encode(), 2: b"short", 4: b""}
    n = {i: sum(int(language_id.opened(part)[1].sum()) for part in language_id.cut_parts(f)) for i, f, _ in sampled(spark, lambda: language_id.training_parts, rows)}
    assert n[1] == sum(len(language_id.subwords(w)) for w in LONG.encode().split()) and len(language_id.cut_parts(language_id.training_parts(LONG.encode()))) == language_id.PARTS


def test_language_logits_from_raw_grams(spark, docs):
    model = language_id.train(docs)

    def plain(text):
        total = np.zeros(len(model.languages))
        n = 0
        for run in re.findall(r"[^\W\d_]+", text or ""):
            run = f"<{run.lower()}>"
            for size in (2, 3, 4):
                for i in range(len(run) - size + 1):
                    total += model.table[zlib.crc32(run[i : i + size].encode()) % language_id.BUCKETS]
                    n += 1
        return total / n + model.bias if n else None

    some = docs.where("doc_id < 40")
    said = {r.doc_id: r for r in language_id.identify(some, model).collect()}
    for r in some.collect():
        x = plain(r.text)
        if x is None:
            assert said[r.doc_id].lang_pred == "und"
            continue
        p = np.exp((x - x.max()) / model.temperature)
        assert said[r.doc_id].lang_pred == model.languages[int(x.argmax())] and abs(said[r.doc_id].score - 1 / p.sum()) < 1e-4
    kept = {r.doc_id for r in language_id.accepted(some, model).collect()}
    assert kept == {k for k, r in said.items() if not r.rejected}


def test_forest_by_walking_its_trees(spark, docs):
    forest = isolation_rules.train(docs, frames.table(spark, SF, "labels"))

    def path(x):
        total = 0.0
        for feature, split, depth in zip(forest.feature, forest.split, forest.depth):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + (2 if x[feature[node]] >= split[node] else 1)
            total += depth[node]
        return 2 ** (-total / len(forest.feature) / forest.norm)

    assert len(forest.feature) == isolation_rules.TREES
    for r in isolation_rules.judge(docs, forest).join(docs.select("doc_id", "text"), "doc_id").collect():
        own = isolation_rules.statistics(np.array([isolation_rules.counts((r.text or "").encode())]))[0]
        low = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert abs(path(own) - r.anomaly) < 1e-9 and r.base_failed == low and r.kept == (not low and path(own) <= forest.limit)


def test_neighbours_by_all_pairs(spark, docs):
    model = neighbour_quality.train(docs, frames.table(spark, SF, "labels"))
    sample = model.vectors.T
    for r in neighbour_quality.classify(docs, model).join(docs.select("doc_id", "text"), "doc_id").where("doc_id < 60").collect():
        counts = np.zeros(neighbour_quality.TERMS, np.float32)
        words = (r.text or "").encode().split()
        for w in words:
            for t in neighbour_quality.word_terms(w):
                counts[t] += 1
        lines = [x.strip() for x in (r.text or "").encode().split(b"\n") if x.strip()]
        counts[-3:] = sum(a == b for a, b in zip(words, words[1:])), len(words) - len(set(words)) if len(words) > 3 * len(set(words)) else 0, len(lines) - len(set(lines))
        own = model.vectors_of(counts[None])[0]
        alike = sorted(((float(own @ v), i) for i, v in enumerate(sample)), reverse=True)[: neighbour_quality.NEIGHBOURS]
        w = [(max(a, 0) ** neighbour_quality.SHARPNESS, i) for a, i in alike]
        total = sum(a * model.votes[i].sum() for a, i in w)
        want = sum(a * model.votes[i, 1] for a, i in w) / total if total > 1e-9 else model.prior
        assert abs(r.score - want) < 1e-3


def test_toxicity_score_is_the_sum_of_weights(spark, docs):
    model = weak_toxicity.Model()
    rng = np.random.default_rng(3)
    model.weights[:] = np.where(rng.random(weak_toxicity.PLACES) < 0.3, rng.normal(size=weak_toxicity.PLACES), 0)
    for r in weak_toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").where("doc_id < 40").collect():
        own = set()
        for w in (r.text or "").split():
            low = w.strip(weak_toxicity._MARKS).lower()
            if low:
                own |= {zlib.crc32(f"w{low}".encode()) % weak_toxicity.BUCKETS} | {zlib.crc32(f"b{low[:k]}".encode()) % weak_toxicity.BUCKETS for k in (4, 5, 6) if len(low) > k}
        words = (r.text or "").encode().split()
        own |= {weak_toxicity.BUCKETS + p for p in weak_toxicity.patterns((r.text or "").encode(), words, set(words))}
        x = -2.0 + sum(float(model.weights[f]) for f in own)
        assert abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, x))))) < 1e-4


def test_label_model_recovers_what_made_the_votes():
    rng = np.random.default_rng(9)
    n, prior = 8000, 0.35
    y = rng.random(n) < prior
    rate_1, rate_0 = np.array([0.7, 0.6, 0.5, 0.5, 0.4, 0.05, 0.1]), np.array([0.05, 0.1, 0.04, 0.05, 0.1, 0.5, 0.4])
    toxic = np.array([True] * 5 + [False] * 2)
    fires = (rng.random((n, 7)) < np.where(y[:, None], rate_1, rate_0)).astype(float)
    again = rng.random(n) < 0.8
    fires[:, 3] = np.where(again, fires[:, 2], fires[:, 3])  # voter 3 mostly repeats voter 2
    post, got_0, got_1, rho = weak_toxicity.label_model(fires, prior, fires[:, toxic].any(1), toxic)
    assert np.abs(got_1 - [fires[y, j].mean() for j in range(7)]).max() < 0.15 and np.abs(got_0 - [fires[~y, j].mean() for j in range(7)]).max() < 0.06
    for_2 = np.mean([np.corrcoef(fires[k, 2], fires[k, 3])[0, 1] for k in (y, ~y)])
    assert abs(rho[2, 3] - for_2) < 0.15 and np.abs(rho[0, [1, 4]]).max() < 0.15
    accurate = weak_toxicity.accuracies(got_0, got_1, prior, toxic)
    assert np.abs(accurate - [np.mean(y[fires[:, j] == 1] == toxic[j]) for j in range(7)]).max() < 0.1
    assert np.mean((post > 0.5) == y) > 0.88


def test_patterns():
    held = lambda t: set(weak_toxicity.patterns(t, t.split(), set(t.split())))
    assert held(b"You are an idiot, really") == {weak_toxicity.ADDRESSED} and held(b"an idiot may be what a man in the moon sees of you") == set()
    assert weak_toxicity.SHOUTING in held(b"THIS IS ALL WRONG AND " * 4) and held(b"what a m*ron") == {weak_toxicity.MASKED}
    assert held(b"no!!") == {weak_toxicity.BANGS} and held(b"Licensed under MIT") == {weak_toxicity.LICENCE} and held(b"") == set()


def test_pairs_near_the_threshold_are_found(spark):
    """Isolated pairs from 0.75 on: found if and only if their full sets reach it."""
    rng = np.random.default_rng(21)
    rows = []
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 204)]
        other = list(words)
        for i in range(int(rng.integers(3, 7))):
            other[10 + 30 * i] = f"v{rng.integers(0, 10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in bbit_minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_pairs(rows)
    assert {k for k in want if want[k] != k} == {k for k in got if got[k] != k} and 60 < len({k for k in want if want[k] != k}) < 300


def brute_pairs(rows):
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    return {k: k - 1 if k % 2 and 100 * len(sets[k] & sets[k - 1]) >= 75 * len(sets[k] | sets[k - 1]) else k for k in sets}


def test_boilerplate_loses_no_link(spark, monkeypatch):
    """Documents that share half of their words meet in buckets over the block's size; a few are near copies."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(k, " ".join(base + [f"u{x}" for x in rng.integers(0, 10**9, 60)])) for k in range(300)]
    rows += [(1000 + k, rows[k][1].replace(rows[k][1].split()[90], "other")) for k in range(0, 300, 9)]
    got = {r.doc_id: r.component_id for r in bbit_minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_matrices_are_read_back(spark, tmp_path):
    df = spark.createDataFrame(ODD, "doc_id long, text string").where("doc_id is not null and doc_id <> 1")
    rows = {r.sequence_id: r for r in fit_packing.digests(df, path=str(tmp_path / "m")).collect()}
    stored = spark.read.parquet(str(tmp_path / "m")).orderBy("sequence_id").collect()
    ids, places = fit_packing.matrix([r.ids for r in stored]), fit_packing.matrix([r.position_ids for r in stored])
    assert ids.shape == places.shape == (len(rows), fit_packing.LENGTH)
    parts = collections.defaultdict(dict)
    for k, r in enumerate(stored):
        said = rows[r.sequence_id]
        want = np.zeros(fit_packing.LENGTH, "<u2")
        for a, b, doc, start in zip(said.cu_seqlens, said.cu_seqlens[1:], said.doc_ids, said.starts):
            parts[doc][start], want[a:b] = ids[k, a:b], np.arange(b - a)
        assert (places[k] == want).all() and said.ids_crc32 == zlib.crc32(ids[k].tobytes()) and said.positions_crc32 == zlib.crc32(want.tobytes())
    for r in df.collect():
        assert np.concatenate([parts[r.doc_id][s] for s in sorted(parts[r.doc_id])]).tolist() == encoded(r.text) + [2]


def test_stages_beside_plain_versions(spark, docs):
    """Each stage keeps what its operator says of its own input, with all columns and odd rows."""
    import corpus_pipeline

    labels, items = frames.table(spark, SF, "labels"), frames.table(spark, SF, "benchmark")
    stages = dict(corpus_pipeline.STAGES)
    extra = spark.createDataFrame([(9001, None, None, "s", 1), (9002, "", "en", None, 0), (None, "a b c d e f g h", None, None, None)], docs.schema)
    own = docs.unionByName(extra).withColumns({c: F.lit("x") for c in ("label", "score", "hash", "node", "digest", "component_id")})

    def kept(name):
        out = stages[name](spark, own, SF)
        assert out.columns == own.columns
        return collections.Counter(r.doc_id for r in out.collect())

    every = collections.Counter(r.doc_id for r in own.collect())
    model = neighbour_quality.train(own, labels)
    low = {r.doc_id for r in neighbour_quality.classify(own, model).collect() if r.score < 0.5}
    assert kept("quality") == collections.Counter({k: n for k, n in every.items() if k not in low})
    rejected = {r.doc_id for r in language_id.identify(own, language_id.train(own)).collect() if r.rejected}
    assert kept("language") == collections.Counter({k: n for k, n in every.items() if k not in rejected}) and {9001, 9002} <= rejected
    first = brute_components([(r.doc_id, r.text) for r in own.collect()])
    assert kept("near_duplicates") == collections.Counter({k: 1 for k in every if first.get(k, k) == k})
    plain = lambda t: f" {' '.join(w for w in (x.strip(template_leaks._MARKS).lower() for x in (t or '').split()) if w)} "
    wanted = [plain(r.text) for r in items.collect()]
    whole = {r.doc_id for r in own.collect() if any(w in plain(r.text) for w in wanted)}
    left = kept("decontaminate")
    assert whole and not whole & set(left) and len(every - left) <= len(whole) + 1
    pieces = collections.defaultdict(dict)
    for r in stages["pack"](spark, own.where("doc_id is not null"), SF).collect():
        assert r.length == 1 << r.bucket and r.offset == 0
        pieces[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4")
    for r in own.where("doc_id is not null and (doc_id < 30 or doc_id > 9000)").collect():
        assert np.concatenate([pieces[r.doc_id][s] for s in sorted(pieces[r.doc_id])]).tolist() == encoded(r.text) + [2]
    assert binary_packing.lengths(5000, 4096) == [4096, 512, 256, 128, 8]


def test_axes_in_blocks_are_those_of_the_whole_decomposition():
    rng = np.random.default_rng(4)
    sample = []
    for i in range(600):  # 60 topics of own terms, so singular values fall off
        counts = np.zeros(neighbour_quality.TERMS, np.float32)
        topic = int(60 * rng.random() ** 2)
        np.add.at(counts, 30 * topic + rng.integers(0, 30, 80), 1)
        there = np.flatnonzero(counts)
        sample.append((i, np.concatenate([there, counts[there]]).astype("<f4").tobytes(), topic % 2))
    model = neighbour_quality.fit(sample, 0.5)
    counts = np.stack([neighbour_quality.unpacked(p) for _, p, _ in sample])
    x = np.sqrt(counts) * model.weights
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    wanted = np.linalg.svd(x.astype(np.float64))[1][: neighbour_quality.DIMENSIONS]
    assert np.allclose(np.sort(np.linalg.norm(x @ model.axes, axis=0))[::-1], wanted, rtol=1e-3)
    assert np.allclose(model.axes.T @ model.axes, np.eye(neighbour_quality.DIMENSIONS), atol=1e-4)
    assert model.vectors.shape == (neighbour_quality.DIMENSIONS, len(sample))
    empty = neighbour_quality.fit([], 0.25)
    assert np.allclose(empty.scores(counts[:3]), 0.25)


def test_no_split_of_a_rate_lies_below_zero():
    rng = np.random.default_rng(3)
    good = rng.uniform(0.1, 0.2, (400, 6))
    good[:, 1:4] = 0  # rates that no good row has
    forest = isolation_rules.grow(good)
    inner = forest.feature >= 0
    assert inner.any() and (forest.split[inner] >= 0).all()
    odd = good[:50].copy()
    odd[:, 1] = 0.3
    assert forest.scores(odd).min() > forest.scores(good).max()


def test_forest_and_limit_come_from_every_labelled_row(spark):
    texts = F.expr("concat(array_join(transform(sequence(1, 60 + cast(id % 17 as int)), i -> concat('w', hash(id, i))), ' '), repeat(' #', cast((id * id) % 5 as int)), repeat(' X', case when id % 20 = 0 then cast(id % 90 as int) else 0 end))")
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), texts.alias("text"))
    labels = docs.selectExpr("doc_id", "cast(doc_id % 20 <> 0 as int) as quality")
    known = isolation_rules.rated(isolation_rules.counted(docs), labels).collect()
    first, label, x = np.array([r.first for r in known]), np.array([r.label for r in known]), np.array([r[2:] for r in known])
    forest = isolation_rules.train(docs, labels)
    good, bad, first = x[label == 1], x[label == 0], first[label == 1]
    assert len(good) == 8550 and len(bad) > 300
    trees, levels = len(forest.feature), forest.levels
    grown, seen = [[] for _ in range(trees)], np.zeros(len(good), int)
    for i, k in enumerate(first):
        for j in range(forest.share):
            grown[(k + j) % trees].append(i)
    margin = 0.05 * (good.max(0) - good.min(0) + 0.02)

    def walk(t, node, level, own):
        f = forest.feature[t, node]
        if f < 0:
            n = len(own)
            assert level == levels or n < 2
            seen[own] += 1
            assert abs(forest.depth[t, node] - level - (0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)) < 1e-9
            return
        v = good[own, f]
        assert max(v.min() - margin[f], 0) <= forest.split[t, node] <= v.max() + margin[f]
        walk(t, 2 * node + 1, level + 1, own[v < forest.split[t, node]])
        walk(t, 2 * node + 2, level + 1, own[v >= forest.split[t, node]])

    for t in range(trees):
        walk(t, 0, 0, np.array(grown[t]))
    assert forest.share >= 1 and (seen == forest.share).all()  # no good row is left out
    here = isolation_rules.grow(good, first=first)
    assert (here.feature == forest.feature).all() and (here.split == forest.split).all() and (here.depth == forest.depth).all()

    def score(row, out=()):
        total, asked = 0.0, 0
        for t in range(trees):
            if t in out:
                continue
            node = 0
            while forest.feature[t, node] >= 0:
                node = 2 * node + (2 if row[forest.feature[t, node]] >= forest.split[t, node] else 1)
            total, asked = total + forest.depth[t, node], asked + 1
        return 2 ** (-total / asked / forest.norm)

    for i in range(0, len(good), 400):  # a good row is judged by the trees that it did not grow
        own = {(first[i] + j) % trees for j in range(forest.share)}
        assert abs(score(good[i], own) - forest.scores(good[i : i + 1], first[i : i + 1])[0]) < 1e-9
    held, low = forest.scores(good, first), forest.scores(bad)
    assert abs(forest.limit - best_limit(held, low)) < 1e-9


def best_limit(held, low, lost=isolation_rules.LOST):
    best = None
    for t in sorted(set(held) | set(low)):
        over = (held > t).sum()
        if over <= lost * len(held):
            gain = (low > t).sum() / max(len(low), 1) - over / len(held)
            if best is None or gain > best[0]:
                best = gain, t
    return best[1]


def test_limit_by_trying_every_score(spark):
    rng = np.random.default_rng(8)
    for n, m, digits, lost in ((400, 200, 2, 0.1), (300, 0, 6, 0.05), (500, 300, 9, 0.02), (3, 2, 3, 0.0), (200, 200, 1, 0.5)):
        held, low = np.round(rng.beta(4, 6, n), digits), np.round(rng.beta(6, 4, m), digits)
        rows = [(float(v), 1) for v in held] + [(float(v), 0) for v in low]
        got = isolation_rules.limit_of(spark.createDataFrame(rows, "score double, label long").repartition(5), lost)
        assert got == best_limit(held, low, lost)
    assert isolation_rules.limit_of(spark.createDataFrame([(0.5, 0)], "score double, label long")) == 1.0


def test_no_good_row_is_lost_to_a_sample(spark):
    usual = F.expr("array_join(transform(sequence(1, 80), i -> concat('w', hash(id, i))), ' ')")
    odd = F.expr("array_join(transform(sequence(1, 80), i -> concat(repeat('#', cast(id / 100 as int)), 'QWERTYUIOPASD', hash(id, i))), ' ')")
    docs = spark.range(9600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 800 == 7, odd).otherwise(usual).alias("text"))
    labels = docs.selectExpr("doc_id", "1 as quality")
    assert [r.doc_id for r in isolation_rules.verdicts(docs, labels).collect() if not r.kept] == []
