"""Counts and collocations against a plain count, for any dealing of rows and sharing of slots, and odd rows."""

import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from faultline.llm import collocations as col
from faultline.llm.support import materialise


def grams(rows):
    """All counts of phrases of one to three words, by language."""
    f = Counter()
    for text, lang in rows:
        lowered = (text or "").encode().lower()
        for piece in re.split(rb"[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split(rb"[ \t]+", piece) if w]
            for m in (1, 2, 3):
                f.update((lang or "und", *words[i : i + m]) for i in range(len(words) - m + 1))
    return f


def plain(rows, top=2000, threshold=10):
    f = grams(rows)
    found = []
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < threshold:
            continue
        around = [n for (other, *more), n in f.items() if n >= threshold and other == lang and len(more) == 3 and len(words) == 2 and tuple(words) in pairwise(more)]
        if any(100 * n >= 50 * a for n in around):
            continue
        cuts = [(f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        left, right = min(cuts, key=lambda c: 1_000_000 * a * a // (c[0] * c[1]))
        found.append((lang, b" ".join(words).decode(), a, left, right, 1_000_000 * a * a // (left * right)))
    out = []
    for lang in {x[0] for x in found}:
        ranked = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[5], -x[2], x[1].encode()))
        n = sum(v for key, v in f.items() if len(key) == 2 and key[0] == lang)
        out += [(lang, rank, *x[1:5], n, x[5]) for rank, x in enumerate(ranked[:top], 1)]
    return sorted(out)


def corpus(seed=1, rows=400):
    choose = random.Random(seed)
    word = [f"{'wW'[i % 2]}{i}" for i in range(150)] + ["é", "ÉTÉ", "#"]
    out = []
    for _ in range(rows):
        words = choose.choices(word, [1 / (i + 1) for i in range(len(word))], k=choose.randint(0, 60))
        words += choose.choice([["new", "york", "city"], ["new", "york"], ["per", "se"], ["per", "se", "x,", "per", "se"], []])
        out.append((choose.choice([" ", "\t", "  "]).join(words) + choose.choice(["", ". W1 w0", "\nw1", "! per se"]), choose.choice(["de", "en", "en", "en", None, "und"])))
    return out


def of(spark, rows, **settings):
    documents = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, n int, phrase string, shard int").repartition(3)
    return sorted(tuple(r) for r in col.collocations(documents, **settings).collect())


@pytest.mark.parametrize("shards, slot_bits", [(3, 23), (2, 18), (5, 15)])
def test_equals_a_plain_count(spark, monkeypatch, shards, slot_bits):
    monkeypatch.setattr(col, "SLOT_BITS", slot_bits)
    monkeypatch.setattr(col, "HELD_BYTES", 4000)
    monkeypatch.setattr(col, "HELD_KEYS", 700)
    rows = corpus(seed=shards)
    want = plain(rows)
    assert len(want) > 100 and {len(x[2].split()) for x in want} == {2, 3}
    assert of(spark, rows, shards=shards) == want


def test_counts_are_whole_when_slots_are_shared(spark, monkeypatch):
    monkeypatch.setattr(col, "SLOT_BITS", 4)
    monkeypatch.setattr(col, "slot_bitmaps", plain_bitmaps)
    rows = corpus(seed=9, rows=120)
    dealt = col.dealt(spark.createDataFrame(rows, "text string, lang string").repartition(2), 4, "lang", "text")
    counts = col.with_words(dealt, col.count_phrases(dealt, 4)).where("length > 0").collect()
    assert {(r.lang, *r.phrase.encode().split(b" ")): r.n for r in counts} == {key: n for key, n in grams(rows).items() if n >= 10}
    assert all(r.length == len(r.phrase.split(" ")) for r in counts)


def plain_bitmaps(rows, lengths):
    import numpy as np

    out = np.zeros((lengths, 2**col.SLOT_BITS), bool)
    for r in rows.where(f"length between 1 and {lengths}").select("length", "k1").collect():
        out[r.length - 1, col.slots(np.array([r.k1], np.int64).view(np.uint64))] = True
    return out


def test_top_and_ties(spark):
    rows = [(" . ".join([f"{a} {b}"] * 10), "en") for a, b in ["ab", "ba", "zz", "éa", "Éb"]] + [("z9 z8 " * 12, None)]
    for top in (2, 4, 5):
        assert of(spark, rows, top=top) == plain(rows, top=top)


def test_odd_rows(spark):
    long = "Big, data! " * 30_000 + "x" * 100_000 + " one two" * 200_000
    rows = [(None, "en"), ("", None), (" \t\n", "en"), (long, "en"), ("one two three " * 10, ""), ("one two three " * 10, ""), (".,;" * 10, "de")]
    assert of(spark, rows) == plain_with_empty(rows)
    assert of(spark, []) == []


def plain_with_empty(rows):
    """An empty language is a language of its own."""
    found = plain([(t, "0" if lang == "" else lang) for t, lang in rows])
    return sorted(("" if x[0] == "0" else x[0], *x[1:]) for x in found)


def test_scores_past_64_bits_are_exact(spark):
    big = 10**14 - 1
    rows = [("en", 1, "a", big), ("en", 1, "b", big - 2), ("en", 1, "c", 10**14 + 7), ("en", 2, "a b", big - 4), ("en", 2, "b c", 3 * 10**13 + 1), ("en", 3, "a b c", 10**13)]
    phrases = materialise(spark.createDataFrame(rows, "lang string, length int, phrase string, n long"), "phrases")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in col.scored(phrases).collect()}
    f = {phrase: n for _, _, phrase, n in rows}
    score = lambda p, x, y: 10**6 * f[p] * f[p] // (f[x] * f[y])
    assert got["a b"] == (f["a b"], f["a"], f["b"], score("a b", "a", "b"))
    assert got["b c"] == (f["b c"], f["b"], f["c"], score("b c", "b", "c"))
    cut = min((score("a b c", "a", "b c"), 1), (score("a b c", "a b", "c"), 2))
    assert got["a b c"][3] == cut[0]


def test_what_passes_between_spark_and_a_worker_is_bounded(spark):
    """A worker's counts leave in batches of a fixed size, and texts come in fewer at once than Spark would send."""
    counter, keys = col.Counter(), np.arange(col.HELD_KEYS, dtype=np.uint64)
    batches = list(counter.add(keys, keys, np.ones(len(keys))))
    assert sum(batch.num_rows for batch in batches) == len(keys) and max(batch.num_rows for batch in batches) <= 2**16
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(col, "count_phrases", lambda *_: seen.append(int(spark.conf.get(name))) or (_ for _ in ()).throw(KeyError))
        with pytest.raises(KeyError):
            col.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string"))
    assert seen[0] <= 1000 and spark.conf.get(name) == before


def test_counts_move_in_blocks_and_are_added_up_by_bucket(spark, monkeypatch):
    """A scan gives a few blocks instead of a row for each key, and every bucket's blocks are added up in one task."""
    monkeypatch.setattr(col, "SLOT_BITS", 15)
    rows = corpus(seed=4)
    dealt = col.dealt(spark.createDataFrame(rows, "text string, lang string").repartition(2), 1, "lang", "text")
    shared = col.sent(spark, np.full((2, 2**15), col.NEVER, np.uint8))
    found = materialise(col.scan(dealt, 0, 1, 3, shared, 2), "found")
    state = materialise(col.merged(found, 1, 1, 10, 2, 2), "state")
    counts = {key: n for key, n in grams(rows).items() if len(key) == 2}
    assert found.count() <= 40 < len(counts) and state.groupBy("bucket").count().where("count > 1").isEmpty()
    kept = sorted(r.n for r in col.counts_of(state).where("length = 1").collect())
    assert kept == sorted(n for n in counts.values() if n >= 10)
    reached = col.reached_slots(state, 2, 2)
    assert reached[1].sum() == 0 < reached[0].sum() <= len(kept)
    assert set(np.flatnonzero(reached[0])) == set(np.flatnonzero(plain_bitmaps(col.counts_of(state), 2)[0]))


def test_keys_that_share_a_half_are_not_mixed():
    ones = np.array([5, 9, 5, 5, 9, 5], np.uint64)
    others = np.array([1, 4, 2, 1, 4, 2], np.uint64)
    n, since = np.arange(1, 7), np.array([255, 3, 255, 2, 255, 255], np.uint8)
    tags = np.full(6, 64, np.int32)
    got = col.added_up([[ones[:3], others[:3], tags[:3], n[:3], since[:3]], [ones[3:], others[3:], tags[3:], n[3:], since[3:]]])
    assert [list(map(int, row)) for row in zip(*got, strict=True)] == [[5, 1, 64, 5, 2], [5, 2, 64, 9, 255], [9, 4, 64, 7, 3]]


def test_blocks_hold_what_was_put_in(monkeypatch):
    monkeypatch.setattr(col, "BLOCK_ROWS", 3)
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 50, np.uint64))
    columns = [keys, keys[::-1], np.arange(50), np.arange(50) * 10**13, np.arange(50)]
    batch = col.blocks(columns, 3)
    assert batch.num_rows >= 17 and batch.column("bucket").to_pylist() == sorted(batch.column("bucket").to_pylist())
    back = [np.concatenate(parts) for parts in zip(*(col.opened(batch.slice(at, 2)) for at in range(0, batch.num_rows, 2)), strict=True)]
    assert all((x == y).all() for x, y in zip(back, columns, strict=True))
    assert set(keys[:3] >> np.uint64(61)) <= set(batch.column("bucket").to_pylist())


def test_a_part_of_the_texts_is_read_by_many_tasks(spark, monkeypatch):
    """Parts are written in small row groups: a task reads at least one."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(col, "GROUP_BYTES", 2**16)
    choose = random.Random(3)
    texts = [("".join(choose.choices("abcdefghijklmnop ", k=2000)), "en") for _ in range(2000)]
    dealt = col.dealt(spark.createDataFrame(texts, "text string, lang string").coalesce(1), 2, "lang", "text")
    groups = [pq.ParquetFile(path.removeprefix("file://").removeprefix("file:")).num_row_groups for path in dealt.inputFiles()]
    assert sum(groups) >= 8
