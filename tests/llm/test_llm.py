"""The operators against brute force, exact round trips and held-out accuracy; and the cases that every one must stand."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanlake.llm import bbit_minhash, binary_packing, fit_packing, frames, isolation_rules, language_id, merkle_fixity, neighbour_quality, subwords, template_leaks, token_rollup, weak_toxicity
from spanlake.llm import queries as llm

SF = "/root/testdata/sf0.001"
ODD = [(1, "Hello, world!"), (1, "Hello, world!"), (2, None), (3, ""), (4, "  \n\t "), (None, "a b c d e f"), (5, "naïve Ωmega 東京 x́ don't I'll ½ 10,5 \x1c \xa0end <|endoftext|>"), (6, "word " * 30_000), (7, "### $$$")]


def table(spark, name):
    return frames.table(spark, SF, name)


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    extra = {c: F.lit("x") for c in ("label", "score", "node", "digest", "band", "key", "n", "hash", "component_id", "kept", "ids", "start", "source", "lang")}
    return rows.withColumns(extra)


def encoded(text):
    t = Tokenizer.from_file(subwords.default_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_chunks_are_the_tokenizers_ids(spark):
    table_ = subwords.ChunkIds(subwords.default_path())
    for text in [t for _, t in ODD if t] + [r.text for r in table(spark, "documents").limit(60).collect()] + [r.html[:3000] for r in table(spark, "pages").limit(5).collect()]:
        assert np.frombuffer(table_.of(text.encode()), "<u4").tolist() == encoded(text)


def test_rollup(spark, tmp_path):
    docs, labels = table(spark, "documents").where("doc_id < 40"), table(spark, "labels")
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in token_rollup.maintained(docs, labels, path=str(tmp_path / "a")).collect()}
    marks = {r.doc_id: r for r in labels.collect()}
    want = collections.defaultdict(lambda: [0, 0, 0])
    import re

    for r in docs.collect():
        m = marks.get(r.doc_id)
        if m and m.quality == 0:
            continue
        text = re.sub("[0-9]+", "#", r.text) if m and m.toxic == 1 else r.text
        for name, n in (("words", len(text.encode().split())), ("word_bpe_49k", len(encoded(text)))):
            w = want[r.source, r.lang, name]
            w[0] += 1
            w[1] += n
            w[2] += len(text)
    assert got == {k: tuple(v) for k, v in want.items()}


def test_ledger_is_idempotent(spark, tmp_path, odd):
    ledger = token_rollup.Ledger(spark, str(tmp_path / "l"))
    assert ledger.rollup().isEmpty()
    counts = token_rollup.count_tokens(odd, {"words": None})
    assert ledger.commit("a", inserts=counts) and not ledger.commit("a", inserts=counts)
    assert ledger.rollup().first().n_docs == len(ODD)
    assert ledger.commit("b", deletes=spark.createDataFrame([(1,), (99,), (None,)], "doc_id long")) and ledger.rollup().first().n_docs == len(ODD) - 2
    assert ledger.commit("c", revisions=token_rollup.count_tokens(odd.where("doc_id = 6").withColumn("text", F.lit("one")), {"words": None}))
    assert ledger.rollup().first().n_tokens == 6 + 7 + 1 + 2 - 0 + len(ODD[6][1].encode().split()) - 7
    assert ledger.batches() == ["a", "b", "c"]
    before = sorted(map(tuple, ledger.rollup().collect()), key=repr)
    assert ledger.compact() and not ledger.compact() and ledger.commit("d", deletes=spark.createDataFrame([(5,)], "doc_id long"))
    assert ledger.rollup().first().n_docs == len(ODD) - 3 and ledger.live(spark.createDataFrame([(5,)], "doc_id long")).isEmpty()
    assert ledger.commit("e", inserts=counts.where("doc_id = 5")) and sorted(map(tuple, ledger.rollup().collect()), key=repr) == before
    assert ledger.commit("f", inserts=counts.limit(0), deletes=counts.limit(0)) and ledger.live().count() == ledger.live().distinct().count()


def test_two_writers_at_once(spark, tmp_path, odd):
    """Both listed the markers before either committed: both batches count once, and the later one sees the earlier."""
    counts = token_rollup.count_tokens(odd, {"words": None}).where("doc_id = 5")
    a, b = [token_rollup.Ledger(spark, str(tmp_path / "l")) for _ in range(2)]
    b.commit("first", inserts=counts)
    listed, took = a._marks, []

    def late(kind):
        marks = listed(kind)
        if kind == "commits" and not took:
            took.append(b.commit("other", inserts=counts))
        return marks

    a._marks = late
    assert a.commit("mine", deletes=spark.createDataFrame([(5,)], "doc_id long")) and took == [True]
    assert a.batches() == ["first", "other", "mine"] and a.rollup().isEmpty() and a.live().isEmpty()
    assert not a.commit("other", inserts=counts) and len(list((tmp_path / "l/changes").iterdir())) == 3


def test_a_claimed_number_is_waited_for(spark, tmp_path, odd):
    counts = token_rollup.count_tokens(odd, {"words": None})
    ledger = token_rollup.Ledger(spark, str(tmp_path / "l"), patience=0.3)
    (tmp_path / "l/commits").mkdir(parents=True)
    (tmp_path / "l/commits/00000000").write_text("")
    assert ledger.batches() == []
    with pytest.raises(RuntimeError, match="never described"):
        ledger.commit("a", inserts=counts)


def test_rollup_of_nothing_and_nulls(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, "a b"), (2, "s", None, None), (None, None, "en", "c")], "doc_id long, source string, lang string, text string")
    labels = spark.createDataFrame([(1, None, 1), (None, 0, 0), (2, 0, None)], "doc_id long, quality int, toxic int")
    versions = {"words": None}
    got = {tuple(r) for r in token_rollup.maintained(docs, labels, versions, str(tmp_path / "a")).collect()}
    assert got == {(None, None, "words", 1, 2, 3), (None, "en", "words", 1, 1, 1)}
    assert token_rollup.maintained(docs.limit(0), labels.limit(0), versions, str(tmp_path / "b")).isEmpty()


def test_segment_tree_is_best_fit():
    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes = rng.integers(1, 33, rng.integers(1, 60)).tolist()
        free, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [f for f in free if f >= sizes[i]]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - sizes[i])
            else:
                free.append(32 - sizes[i])
        got = fit_packing.best_fit_decreasing(sizes, 32)
        assert sorted(i for s in got for i in s) == list(range(len(sizes)))
        assert sorted(32 - sum(sizes[i] for i in s) for s in got) == sorted(free)


def test_fit_packing_is_lossless(spark, odd):
    docs = table(spark, "documents").select("doc_id", "text").unionByName(odd.where("doc_id <> 1").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    repeated = [(d, s) for r in fit_packing.packed(odd, length=64).collect() for d, s in zip(r.doc_ids, r.starts)]
    assert repeated.count((1, 0)) == 2 and repeated.count((None, 0)) == 1 and fit_packing.packed(odd.limit(0)).isEmpty()
    assert binary_packing.digests(odd.limit(0)).isEmpty()
    parts, n = collections.defaultdict(dict), 0
    for r in fit_packing.packed(docs, length=512).collect():
        ids, places = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids <= 512
        for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
            assert places[a:b].tolist() == list(range(b - a))
            parts[d][s] = ids[a:b]
        assert not ids[r.n_ids :].any() and not places[r.n_ids :].any()
        n += 1
    for r in docs.collect():
        assert np.concatenate([parts[r.doc_id][s] for s in sorted(parts[r.doc_id])]).tolist() == encoded(r.text) + [2]
    assert n <= 1.03 * sum(len(x) for p in parts.values() for x in p.values()) / 512 + 4


def test_binary_packing(spark, odd, tmp_path):
    rows = binary_packing.sequences(odd).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length == 1 << r.bucket and r.length <= 4096 and r.offset == 0 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for key, text in ODD:
        own = sorted(by[key], key=lambda r: r.start)[:: 2 if key == 1 else 1]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == encoded(text) + [2]
        assert own[-1].start + own[-1].length == own[0].doc_tokens
    d = binary_packing.digests(odd).where("doc_id = 5").collect()
    assert all(r.ids_crc32 == zlib.crc32(next(x.ids for x in by[5] if x.start == r.start)) for r in d)
    binary_packing.write_buckets(binary_packing.sequences(odd), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == len(rows)
    with pytest.raises(ValueError):
        binary_packing.pieces(odd, longest=1000)


def test_rule_counts():
    def plain(text):
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if __import__("re").search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, dup, len(hit)

    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("ab \n#é🙂"), rng.integers(0, 80))) for _ in range(300)] + ["the the the the", "a b c a b c", "x\nx\n x\n\n\n", None, ""]
    for text in made + [t for _, t in ODD]:
        assert isolation_rules.counts(text.encode() if text is not None else None)[:5] == plain(text)


def held_out(rows, marks, name, parts, out):
    known = [(r, marks[r.doc_id][name]) for r in rows if r.doc_id in marks and zlib.crc32(str(r.doc_id).encode()) % parts == out]
    assert all(r.held_out and 0 <= r.score <= 1 for r, _ in known)
    return known


BIG = "/root/testdata/sf0.01"


def test_sample_is_the_low_end_of_the_hash(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    labelled = docs.selectExpr("doc_id", "case when doc_id % 40 = 0 then 'rare' else 'usual' end as label")
    ranked = [(r.doc_id, r.text.encode(), r.label) for r in docs.join(labelled, "doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))).collect()]
    want = collections.defaultdict(list)
    for r in ranked:
        want[r[2]].append(r)
    got = frames.bounded_sample(docs, labelled, 150, lambda: bytes)
    assert got == [r for r in ranked if r in want["rare"][:150] or r in want["usual"][:150]] and len(got) == 250
    assert frames.bounded_sample(docs.limit(0), labelled.limit(0), 150, lambda: bytes) == []
    with pytest.raises(ValueError):
        frames.bounded_sample(docs, labelled, 150, lambda: bytes, most_labels=1)


def test_classifiers_on_held_out_rows(spark):
    docs, labels = frames.table(spark, BIG, "documents"), frames.table(spark, BIG, "labels")
    marks = {r.doc_id: r for r in labels.collect()}
    known = held_out(neighbour_quality.predictions(docs, labels).collect(), marks, "quality", 3, 1)
    assert np.mean([r.predicted == y for r, y in known]) > 0.97
    known = held_out(weak_toxicity.predictions(docs, labels).collect(), marks, "toxic", 5, 0)
    assert np.mean([r.predicted == y for r, y in known]) > 0.9
    assert np.mean([r.score for r, y in known if y]) > 3 * np.mean([r.score for r, y in known if not y])
    verdicts = {r.doc_id: r for r in isolation_rules.verdicts(docs, labels).collect()}
    good = [verdicts[k].kept for k, m in marks.items() if m.quality == 1 and not verdicts[k].base_failed]
    bad = [verdicts[k].kept for k, m in marks.items() if m.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_language(spark, odd):
    docs = frames.table(spark, BIG, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.predictions(docs).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97 and np.mean([r.rejected for r in rows]) < 0.02
    model = language_id.fit([(i, language_id.training_parts(("the cat and dog" if i % 2 else "der hund und die katze").encode() * 3), "en" if i % 2 else "de") for i in range(40)])
    said = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [said[k].lang_pred for k in (2, 3, 4, 7)] == ["und"] * 4 and said[1].lang_pred in ("en", "de") and said[2].rejected
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit([])).collect()} == {"und"}


def test_scorers_stand_odd_rows(spark, odd):
    empty_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (5, 1, 0), (6, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for use in (empty_labels, labels):
        for rows in (neighbour_quality.predictions(odd, use), weak_toxicity.predictions(odd, use), isolation_rules.verdicts(odd, use), isolation_rules.verdicts(odd.limit(0), use)):
            assert rows.count() in (len(ODD), 0)
    assert neighbour_quality.predictions(odd.limit(0), labels).isEmpty() and weak_toxicity.predictions(odd.limit(0), empty_labels).isEmpty() and language_id.predictions(odd.limit(0)).isEmpty()


def brute_components(rows):
    sets = {}
    for key, text in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
        own = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        if key is not None and own:
            sets.setdefault(key, []).append(own)
    nodes = list(sets)
    root = {k: k for k in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in nodes}


def test_near_duplicates_against_brute_force(spark, odd):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 500, 160)]
    near = []
    for k in range(120):  # many near copies of one text, of which some are only near each other
        words = list(base)
        for i in rng.choice(160, rng.integers(0, 9), replace=False):
            words[i] = f"v{rng.integers(0, 9)}"
        near.append((1000 + k, " ".join(words)))
    rows = [(r.doc_id + 5000, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()] + near + [(k, t) for k, t in ODD] + [(1000, "another text under a doc_id that is taken " * 3)]
    got = bbit_minhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id, r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert bbit_minhash.groups(odd).count() == len(ODD) and bbit_minhash.groups(odd.limit(0)).isEmpty()
    kept = bbit_minhash.first_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1


def test_bit_estimate_follows_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.75, 0.95):
        errors = []
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            n = int(1000 * share)
            a, b = pool[:1000], np.concatenate([pool[:n], pool[1000 : 2000 - n]])
            true = n / (2000 - n)
            est = bbit_minhash._estimates(bbit_minhash.packed_bits(bbit_minhash.minima(a))[None], bbit_minhash.packed_bits(bbit_minhash.minima(b))[None])[0, 0]
            errors.append(est - true)
        assert abs(np.mean(errors)) < 0.03


def test_blocks_give_the_links_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bbit_minhash, "BLOCK", 7)
    test_near_duplicates_against_brute_force(spark, spark.createDataFrame(ODD, "doc_id long, text string"))


def test_common_by_product_is_common_by_intersection():
    rng = np.random.default_rng(6)
    own = [np.unique(rng.integers(0, 300, 80).astype(np.uint64)) for _ in range(60)]
    left, right = np.arange(60), np.arange(60)
    pairs = np.nonzero(np.ones((60, 60), bool))
    assert bbit_minhash.common(own, left, right, pairs).tolist() == [len(np.intersect1d(own[i], own[j])) for i, j in zip(*pairs)]


def test_leaks(spark, odd):
    items = spark.createDataFrame([(1, "A train leaves Boston at 5 pm and travels 60 miles each hour until it has reached Denver after some stops"), (2, "short"), (3, None), (None, "x y z w v u t s r q")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "noise before. A train leaves Boston at 5 pm and travels 60 miles each hour until it has reached Denver after some stops and noise"),
         (2, "So: a train leaves Paris at 7 pm and travels 45 miles each hour until it has reached Rome after some stops"),
         (3, "a train is fast and Denver is far while nothing else of that kind is said in here at all"), (4, None), (None, "A train leaves Boston at 5 pm and travels 60 miles each hour until it has reached Denver after some stops")],
        "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in template_leaks.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[1, 1].same_values and not got[2, 1].same_values
    assert template_leaks.leaks(odd, items.limit(0)).isEmpty() and template_leaks.leaks(odd.limit(0), items).isEmpty()
    assert template_leaks.clean(docs, items).count() == 3
    one = (0, 0, [template_leaks.NAME, 0, template_leaks.NAME], [5, 1, 5], [8, 1, 9])
    assert template_leaks.consistent([one])[0] == set()


def test_leaks_of_dense_items(spark):
    """Items with more numbers, units and names than fixed words: verbatim, in another context, and with other values."""
    train, title = "A train travels 60 km in 2 hours and then 90 km in 3 hours.", "What Is The Capital City Of The French Republic Today?"
    german = "Welche Stadt Liegt Am Fluss Rhein Zwischen Köln Und Bonn Mit Dom Heute?"
    few = "Take 3 kg 4 kg 5 kg 6 kg 7 kg 8 kg of tin"
    items = spark.createDataFrame([(1, train), (2, title), (3, german), (4, "1 2 3 5 8 13 21 34 55 89"), (5, few), (6, "Anna Berta Clara Dora Emma")], "item_id long, text string")
    kept = [t.windows(template_leaks.WINDOW) for t in [template_leaks.template(train.encode(), template_leaks.Words())]][0]
    docs = spark.createDataFrame(
        [(1, f"noise {train} And noise"), (2, f"We asked {title} Nobody knew"), (3, f"Frage. {german} Niemand weiss es"), (4, "so 1, 2, 3, 5, 8, 13, 21, 34, 55, 89 go on"),
         (5, "noise. A train travels 80 km in 4 hours and then 70 km in 5 hours."), (6, f"so {few}"), (7, title.lower()), (8, "we saw Anna Berta Clara Dora Emma there"),
         (9, "A train travels 60 km in 60 hours and then 60 km in 60 hours."), (10, "1 2 3 4 5 6 7 8 9 10 11 12"), (11, "Anna Otto Clara Dora Emma What Is The Price Of The Dutch Tulip Market Now")],
        "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in template_leaks.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, 5), (7, 2), (8, 6)}
    assert got[1, 1].share == 1 and got[1, 1].n_windows == len(kept) == 8 and got[1, 1].same_values and not got[5, 1].same_values
    assert {r.doc_id for r in template_leaks.clean(docs, items).collect()} == {9, 10, 11}


def test_leaks_of_passages(spark):
    """A passage of a long item is found whatever its share of the item; shorter ones and scattered windows are not."""
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a, b in zip(rng.choice(list("bcdfgh"), 200), rng.integers(1000, 9999, 200).astype(str))]
    words[70], words[90] = "Boston", "Boston"
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    swapped = ["Paris" if w == "Boston" else w for w in words]
    unlike = [*words[60:90], "Paris", *words[91:100]]
    docs = spark.createDataFrame(
        [(1, "noise " + " ".join(words[60:120]) + " noise"), (2, "noise " + " ".join(swapped[60:120])), (3, "noise " + " ".join(words[60:91])), (4, "noise " + " ".join(words[60:92])),
         (5, " and ".join(" ".join(words[i : i + 10]) for i in range(0, 200, 20))), (6, "noise " + " ".join(unlike))],
        "doc_id long, text string")
    got = {r.doc_id: r for r in template_leaks.leaks(docs, items).collect()}
    assert set(got) == {1, 2, 4} and got[1].n_found == 53 and got[1].n_windows == 193 and got[1].same_values and not got[2].same_values


def test_leaks_of_short_items(spark):
    items = spark.createDataFrame([(1, "What is 17 * 24?"), (2, "E = m c"), (3, ""), (4, None), (5, "$$$"), (6, " \n"), (7, "Tallinn")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "So: what is 17 * 24? And what is 17 * 24?"), (2, "What is 17 + 24?"), (3, "What is 18 * 24?"), (4, "What is 17 24?"), (5, "(E = m c)"), (6, "E m c"), (7, "a $$$ b"), (8, ""), (9, None), (10, "What is 17 *"), (11, "to Tallinn.")],
        "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_found, r.same_values) for r in template_leaks.leaks(docs, items).collect()}
    assert got == {k: (1, 1, True) for k in [(1, 1), (5, 2), (7, 5), (11, 7)]} | {(3, 1): (1, 1, False)}


def test_leaks_of_whole_items_with_other_numbers(spark):
    """An item whose windows are all dense is found verbatim and with other numbers, but not with other signs."""
    items = spark.createDataFrame([(1, "What is 12 + 5 - 3 * 7 ?"), (2, "1 2 3 4 5 6 7"), (3, "$ 1 $ 2 $ 3 $ 4 $")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "noise. What is 12 + 5 - 3 * 7 ? noise"), (2, "Now, what is 31 + 8 - 2 * 9 ? Ask"), (3, "what is 31 + 8 - 2 + 9 ?"), (4, "what is 31 8 2 9 ?"), (5, "2 3 4 5 6 7 8"), (6, "What is 12 + 12 - 3 * 7 ?"), (7, "$ 2 $ 2 $ 2 $ 2 $")],
        "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.same_values for r in template_leaks.leaks(docs, items).collect()}
    assert got == {(1, 1): True, (2, 1): False}


def test_planted_reparameterised_items(spark):
    """Of problems with other numbers and names planted in prose, at least nine of ten are found, and no clean document."""
    rng = np.random.default_rng(12)
    prose = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "nd rt sk mb lt".split()]
    names, templates = ["Anna", "Otto", "Clara", "Dora", "Emil", "Frida"], [
        "If {n} buys {a} apples for {b} euros each and sells them for {c} euros how much does {n} earn",
        "A train travels {a} km in {b} hours and then {c} km in {b} hours so how fast is it on average",
        "{n} has {a} books and gives {b} of them to {m} who had {c} books before and then counts them all",
        "What is {a} + {b} - {c} * {a} ?",
        "A tank holds {a} liters and loses {b} liters each hour until {c} liters are left so how long does it take",
    ]

    def made(k, seed):
        r = np.random.default_rng(seed)
        n, m = r.choice(names, 2, replace=False)
        a, b, c = r.choice(np.arange(2, 90), 3, replace=False)
        return templates[k].format(n=n, m=m, a=a, b=b, c=c)

    items = spark.createDataFrame([(k, made(k, 100 + k)) for k in range(len(templates))], "item_id long, text string")
    rows = []
    for i in range(60):
        words = rng.choice(prose, 120).tolist()
        rows.append((i, " ".join(words[:50] + ([". " + made(i % 5, 1000 + i)] if i < 40 else []) + [".", *words[50:]])))
    got = {(r.doc_id, r.item_id) for r in template_leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    planted = {(i, i % 5) for i in range(40)}
    assert got <= planted and len(got) >= 0.9 * len(planted)


def test_leaks_against_brute_force(spark):
    docs, items = frames.table(spark, BIG, "documents"), frames.table(spark, BIG, "benchmark")

    def plain(t):
        return [w.strip(template_leaks._MARKS).lower() for w in t.split() if w.strip(template_leaks._MARKS)]

    found = {(r.doc_id, r.item_id) for r in template_leaks.leaks(docs, items).collect()}
    wanted = {r.item_id: " ".join(plain(r.text)) for r in items.collect()}
    whole = {(r.doc_id, i) for r in docs.collect() for t in [f" {' '.join(plain(r.text))} "] for i, w in wanted.items() if f" {w} " in t}
    assert whole and whole <= found and len({d for d, _ in found} - {d for d, _ in whole}) <= 2


def test_fixity(spark, tmp_path):
    import compare

    assert compare.same(spark, SF, llm.queries()["op6_merkle_fixity"], merkle_fixity.ORACLE) == ""
    pages = spark.createDataFrame([(i, f"u{i}" if i % 7 else None, "x" * i if i % 5 else None) for i in range(700)] + [(None, "n", "h"), (3, "u3", "xxx")], "page_id long, url string, html string")
    one = merkle_fixity.records(pages)
    assert merkle_fixity.audit(one, one).isEmpty() and merkle_fixity.audit(one.limit(0), one.limit(0)).isEmpty()
    got = merkle_fixity.audit(one, one.where("not (file = 0 and seq in (698, 699, 700))")).collect()
    assert {(r.kind, r.seq) for r in got} >= {("missing", 700)}
    # trees of unlike size: 20 small files and one that is a level higher in one replica alone
    files = spark.range(21 * 10).selectExpr("id div 10 as file", "id % 10 as seq", "(id % 10) * 5 as start", "5L as length", "sha2(string(id), 256) as digest")
    longer = files.unionByName(spark.range(10, 300).selectExpr("0L as file", "id as seq", "id * 5 as start", "5L as length", "sha2(string(-id), 256) as digest"))
    a, b = [[x.digest for x in merkle_fixity.tree(r, merkle_fixity.height_of(files, longer))[-1].orderBy("file").collect()] for r in (files, longer)]
    assert len(a) == len(b) == 21 and [i for i in range(21) if a[i] != b[i]] == [0]
    got = merkle_fixity.audit(files, longer.withColumns({"label": F.lit(1), "node": F.lit(2), "up": F.lit(3)})).collect()
    assert {(r.kind, r.file) for r in got} == {("extra", 0)} and len(got) == 290
    assert merkle_fixity.audit(files, files.union(files)).isEmpty() and merkle_fixity.audit(files, files.union(files.selectExpr("null", "seq", "start", "length", "digest"))).isEmpty()
    for k, compress in enumerate((False, True)):
        rows = [(i, f"http://e/{i}", f"<p>{i} é</p>") for i in range(40)]
        for side in "ab":
            (tmp_path / f"{side}{k}").mkdir()
        whole = bytearray(merkle_fixity.write_warc(rows, compress))
        (tmp_path / f"a{k}/f.warc").write_bytes(bytes(whole))
        bad = [(i, u, h.replace("17", "71")) for i, u, h in rows]
        (tmp_path / f"b{k}/f.warc").write_bytes(merkle_fixity.write_warc(bad, compress))
        a, b = merkle_fixity.read_warc(spark, str(tmp_path / f"a{k}")), merkle_fixity.read_warc(spark, str(tmp_path / f"b{k}"))
        assert a.count() == 40 and [(r.seq, r.kind) for r in merkle_fixity.audit(a, b).collect()] == [(17, "altered")]


def test_scan_of_damaged_files():
    whole = merkle_fixity.write_warc([(1, "u", "<p>a</p>"), (2, "v", "<p>b</p>")])
    assert [x[1] for x in merkle_fixity.scan(whole)] == [len(whole) // 2] * 2
    assert len(merkle_fixity.scan(whole.replace(b"Content-Length", b"Content-Wrong", 1))) == 1  # nothing tells where the next one starts
    assert merkle_fixity.scan(b"") == [] and merkle_fixity.scan(b"\x1f\x8bno gzip")[0][:2] == (0, 9)
    cut = merkle_fixity.scan(whole[:-7])
    assert len(cut) == 2 and cut[1][0] + cut[1][1] == len(whole) - 7


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0.6 * docs.count() < out.count() <= docs.count()
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.select("doc_id").distinct().count() < docs.count()
