"""Found items against counting all shingles, items in pieces, and odd rows."""

import random

import numpy as np

from faultline.llm import decontamination as dec
from faultline.llm.support import WordHashes


def plain(documents, items):
    def shingles(text):
        words = (text or "").lower().encode().translate(dec.PLAIN).split()
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    out = set()
    for doc_id, text in documents:
        own = shingles(text)
        for item_id, item in items:
            wanted = shingles(item)
            if wanted and len(own & wanted) / len(wanted) >= 0.8:
                out.add((doc_id, item_id, len(own & wanted), len(wanted)))
    return sorted(out, key=str)


def tables():
    choose = random.Random(4)
    word = lambda: "".join(choose.choice("abcdefghijkl") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(choose.choice([5, 9, 12, 20, 45, 70]))) for i in range(40)] + [(40, "too few words"), (41, None), (42, "")]
    documents = [(i, prose(choose.randint(5, 300))) for i in range(100)]
    for i, (_, item) in enumerate(items[:40]):
        words = item.split()
        documents.append((200 + i, f"{prose(3000 * (i % 3))} {item} {prose(30)}"))
        documents.append((300 + i, f"{prose(50)} {' '.join(words[: len(words) * 9 // 10])} {prose(50)}"))
        documents.append((400 + i, f"{' '.join(words[: len(words) // 2])} {prose(40)} {' '.join(words[len(words) // 2 - 4 :])}"))
        documents.append((500 + i, f"{prose(9)} {' '.join(words[: len(words) // 2])} {prose(9)}"))
    documents += [(600, items[3][1].upper().replace(" ", "!! ")), (600, items[3][1]), (None, items[4][1]), (601, None), (602, ""), (200, documents[100][1])]
    return documents, items


def test_equals_counting_all_shingles(spark):
    documents, items = tables()
    docs = spark.createDataFrame([(*d, "x", 1) for d in documents], "doc_id long, text string, keys string, k int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dec.contained_items(docs, bench).select("doc_id", "item_id", "n_shared", "n_item").collect()
    assert sorted({tuple(r) for r in found}, key=str) == plain(documents, items)
    clean = dec.without_contaminated(docs, bench)
    bad = {i for i, *_ in plain(documents, items)}
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, _ in documents if i not in bad), key=str)


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    documents, items = tables()
    monkeypatch.setattr(dec, "TABLE_BITS", 19)
    monkeypatch.setattr(dec, "on_set_bits", lambda bits, values: np.ones(len(values), bool))
    docs, bench = spark.createDataFrame(documents[:150], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = dec.contained_items(docs, bench).select("doc_id", "item_id", "n_shared", "n_item").collect()
    assert sorted({tuple(r) for r in found}, key=str) == plain(documents[:150], items)


def test_empty_tables(spark):
    documents, items = tables()
    docs, bench = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dec.contained_items(docs.limit(0), bench).count() == 0
    assert dec.contained_items(docs, bench.limit(0)).count() == 0
    assert dec.without_contaminated(docs, bench.limit(0)).count() == len(documents)


def test_windows_hold_every_unbroken_item():
    hashes, choose = WordHashes(), random.Random(2)
    text = " ".join(f"w{choose.randrange(10**9)}" for _ in range(500))
    values = dec.shingles(text, hashes)
    for start in range(0, 400, 7):
        for size in (1, 6, 15, 40, 63):
            item = np.unique(values[start : start + size])
            keys = set(dec.item_keys(item).tolist())
            assert keys & set(dec.window_keys(values, [dec.size_class(len(item))]).tolist())


def test_bit_tables():
    bits, values = np.zeros(2**dec.TABLE_BITS // 8, np.uint8), np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2)
    dec.set_bits(bits, values)
    assert dec.on_set_bits(bits, values).all() and bits.any()
