"""The coder's round trip, damaged files, and files against the library's ids."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultline.llm import token_files
from faultline.llm.rans import SEGMENT, Frequencies, decode_segment, encode_block
from faultline.llm.support import new_folder
from faultline.llm.token_files import FileReader, FileWriter, WordIds, frequent_words, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\r", "\t", "\xa0", "　", "᠎", "\x1c", "\x85", "​", "é", "漢", "😀", "1", ",", ".", "'s", "don't", '"', "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer_json():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


@pytest.mark.parametrize("size", [1, 2047, 2049, 70_000, SEGMENT + 5])
def test_round_trip(size):
    ids = np.minimum(np.random.default_rng(size).geometric(0.002, size), 50_256).astype(np.uint32)
    table = Frequencies.from_counts(np.bincount(ids))
    same = Frequencies.unpacked(table.packed())
    parts = [decode_segment(s, same, same.slots()) for s in encode_block(ids, table)]
    assert (np.concatenate(parts) == ids).all()


def test_damage_is_seen():
    ids = np.arange(5000, dtype=np.uint32) % 7
    table = Frequencies.from_counts(np.bincount(ids))
    segment = bytearray(encode_block(ids, table)[0])
    segment[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        decode_segment(bytes(segment), table, table.slots())


def test_word_cache_equals_the_library(library, tokenizer_json):
    words, choose = WordIds(tokenizer_json), random.Random(6)
    for _ in range(6000):
        text = "".join(choose.choice(PIECES) for _ in range(choose.randint(0, 20)))
        assert np.frombuffer(words.of_text(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_letters_are_given_to_the_model_alone(library, tokenizer_json, monkeypatch):
    words, whole = WordIds(tokenizer_json), []
    monkeypatch.setattr(words, "encode", lambda text: whole.append(text) or WordIds.encode(words, text))
    letters = [chr(c) for c in range(1, 0x300) if chr(c).isalpha()]
    choose = random.Random(2)
    texts = [before + "".join(choose.choices(letters, k=choose.randint(1, 5))) for before in ("", " ", "\n") for _ in range(3000)]
    for text in [*texts, "", " ", "\n", "été du Nord,", "ªº ǅŉ", "don't"]:
        assert np.frombuffer(words.of_text(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    whole.clear()
    words.of_text("Straßenmusikanten\nspielen été, vor Häusern.")
    assert set(whole) <= {",", "."}
    assert WordIds(tokenizer_json.replace('"normalizer":null', '"normalizer":{"type":"Lowercase"}').replace('"normalizer": null', '"normalizer": {"type": "Lowercase"}')).model is None


def test_documents_across_segments(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RUN", 2 * SEGMENT)
    path, random_state = str(tmp_path / "x.bin"), np.random.default_rng(1)
    writer, texts = FileWriter(path), [random_state.integers(0, 99, n).astype(np.uint32) for n in (5, SEGMENT - 5, 3, 3 * SEGMENT, 1, 10)]
    for number, ids in enumerate(texts):
        writer.add(number or None, ids)
    writer.close()
    reader, found = FileReader(path), []
    for segment in range(len(reader.places)):
        found += [(i, s, np.concatenate(list(parts))) for i, s, parts in reader.documents(segment, segment + 1)]
    assert [i for i, _, _ in found] == [None, 1, 2, 3, 4, 5]
    assert all((got == ids).all() for (_, _, got), ids in zip(found, texts, strict=True))
    data = bytearray((tmp_path / "x.bin").read_bytes())
    data[-20] ^= 255
    (tmp_path / "y.bin").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        FileReader(str(tmp_path / "y.bin"))


def test_files_equal_the_library(spark, library, tokenizer_json):
    rows = [(i, f"Row {i},\nsome text. " * (i % 9), "c") for i in range(200)] + [(None, "no id", "c"), (7, None, "c"), (8, "", "c"), (9, "b", "c"), (9, "a", "c"), (300, "long " * 100_000, "c")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(5)
    got = [tuple(r) for r in read_token_files(write_token_files(documents, new_folder(spark, "tokens"), tokenizer_json, 2)).collect()]
    want, start = [], 0
    digest = lambda text: "" if text is None else hashlib.md5(text.encode()).hexdigest()
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1]))):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    empty = write_token_files(documents.limit(0), new_folder(spark, "tokens"), tokenizer_json, 2)
    assert read_token_files(empty).count() == 0


def test_frequent_words_change_no_id(spark, tokenizer_json):
    texts = ["the cat sat", "the cat  sat\nthe mat", "a\0b the cat", "the\tcat", "\nthe cat ", None, ""]
    documents = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    frequent = frequent_words(documents, tokenizer_json)
    assert " cat" in frequent[0].split("\0")
    seeded, plain = WordIds(tokenizer_json, frequent), WordIds(tokenizer_json)
    assert len(seeded) > len(plain) == 0
    for text in texts:
        assert seeded.of_text(text) == plain.of_text(text)
    assert frequent_words(documents.limit(0), tokenizer_json) == ("", b"", b"")
