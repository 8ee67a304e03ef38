"""Packing: every token once, no bin too full, no conflict, and the tightest compatible bin by a plain search."""

import random
from collections import Counter, defaultdict

from faultline.llm.ngram_join import fingerprints
from faultline.llm.packing import measured, op9_packing, pack, packed, with_cluster
from faultline.llm.token_counts import token_counter, token_counts


def plain_pack(lengths, sources, clusters, capacity, per_source):
    bins = []  # of lists of piece numbers
    for i, length in enumerate(lengths):
        best = None
        for number, held in enumerate(bins):
            free = capacity - sum(lengths[j] for j in held)
            fits = 0 < free >= length and not any(clusters[i] is not None and clusters[j] == clusters[i] for j in held)
            fits = fits and (sources[i] is None or sum(sources[j] == sources[i] for j in held) < per_source)
            if fits and (best is None or free < best[0]):
                best = (free, number)
        if best is None:
            bins.append([i])
        else:
            bins[best[1]].append(i)
    return {i: number for number, held in enumerate(bins) for i in held}


def test_equals_a_plain_best_fit():
    choose = random.Random(7)
    for _ in range(60):
        n = choose.randint(0, 80)
        lengths = sorted((choose.randint(1, 50) for _ in range(n)), reverse=True)
        sources = [choose.choice(["a", "a", "b", None]) for _ in range(n)]
        clusters = [choose.choice([1, 1, 2, 3, 4, None]) for _ in range(n)]
        numbers, places = pack(lengths, sources, clusters, 50, 3)
        assert dict(enumerate(numbers)) == plain_pack(lengths, sources, clusters, 50, 3)
        ends = defaultdict(list)
        for number, place, length in zip(numbers, places, lengths, strict=True):
            ends[number].append((place, place + length))
        assert all(a[1] == b[0] for spans in ends.values() for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))


def test_whole_table(spark):
    choose = random.Random(3)
    rows = [(i, choose.choice([1, 20, 64, 65, 300, 1000]), "hot" if i % 3 == 0 else f"s{i % 9}", 5 if i % 4 == 0 else i) for i in range(900)]
    odd = [(None, 30, None, None), (1, None, "s", 1), (2, 0, "s", 2), (3, -4, "s", 3), (7, 10, "s", 7), (7, 10, "s", 7)]
    items = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, length int, source string, cluster long, shard string").repartition(4)
    got = packed(items, 64, 2, 100).collect()
    of_bin = defaultdict(list)
    for r in got:
        of_bin[r.bin_id].append(r)
    facts = {i: (s, c) for i, _, s, c in rows}
    for held in of_bin.values():
        assert sum(r.n_tokens for r in held) <= 64
        known = [facts[r.doc_id] for r in held if r.doc_id in facts and r.doc_id != 7]
        assert max(Counter(s for s, _ in known).values(), default=0) <= 2
        assert max(Counter(c for _, c in known).values(), default=0) <= 1
    total = Counter()
    for r in got:
        assert r.start == 64 * r.piece
        total[r.doc_id] += r.n_tokens
    want = Counter()
    for i, length, *_ in rows + odd:
        want[i] += max(length or 0, 0)
    assert total == +want
    assert packed(items.limit(0), 64).count() == 0


def test_near_copies_never_share_a_bin(spark, tmp_path):
    choose = random.Random(5)
    word = lambda: "".join(choose.choice("abcdefgh") for _ in range(5))
    base = " ".join(word() for _ in range(60))
    near = [base, f"{base} ", f"{base}\n", base.replace(" ", "  ", 3), base, *(f"{base} {word()}" for _ in range(15))]
    other = [" ".join(word() for _ in range(60)) for _ in range(20)]
    rows = [(i if i else None, t, f"s{i}") for i, t in enumerate(near)] + [(100 + i, t, f"t{i}") for i, t in enumerate(other)] + [(200, "", "u"), (201, None, "u"), (202, "  ", "u")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    cluster = {r.source: r.cluster for r in with_cluster(documents, "cluster").where("text != ''").collect()}
    assert len({cluster[f"s{i}"] for i in range(20)}) == 1 and len({cluster[f"t{i}"] for i in range(20)}) == 20
    got = op9_packing(spark, str(tmp_path)).collect()
    bins = Counter(r.bin_id for r in got if r.doc_id is None or r.doc_id < 100)
    assert len(bins) == 20 and max(bins.values()) == 1
    assert {r.doc_id for r in got} >= {None, *range(1, 20), *range(100, 120)}


def test_measured_rows_and_documents_without_tokens(spark, tmp_path):
    import public_tokenizers

    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "a"), (2, base, "b"), (3, f"{base} more", "a"), (4, None, "a"), (5, "", None), (6, "two words", "c"), (7, "two words", "c"), (None, "other", "c")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in measured(documents, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert len(got) == 8 and got[1].length == got[2].length > 60 and got[4].length == got[5].length == 0
    assert got[1].cluster == got[2].cluster == got[3].cluster and got[6].cluster == got[7].cluster != got[1].cluster
    assert got[4].cluster is None and got[6].source == "c"
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    packed_rows = op9_packing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in packed_rows) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert [(r.n_tokens, r.bin_id, r.place) for r in packed_rows if r.doc_id in (4, 5)] == [(0, None, None)] * 2


def test_a_cluster_column_is_replaced(spark):
    documents = spark.createDataFrame([(1, "a b c", 9)], "doc_id long, text string, cluster int")
    assert with_cluster(documents, "cluster").columns == ["doc_id", "text", "cluster"]


def test_tokens_and_shingles_take_one_worker_a_task(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "w " * 7000), (4, "the cat sat on the mat")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    prints = fingerprints(texts, measures={"n_tokens": token_counter(texts, path, order=["doc_id"])})
    plan = prints._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    want = token_counts(texts, path, order=["doc_id"])
    assert sorted((r.doc_id, r.n_tokens) for r in prints.collect()) == sorted((r.doc_id, r.n_tokens) for r in want.collect())
