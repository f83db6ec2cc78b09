import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from quern.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [None, "", " ", "   ", "\n\n x", "Hello world, it's 2024!", "naïve Übermut ñandú 日本語のテキスト \U0001f600", "a" * 300, "a" * 20_000, "日本" * 3000, "x  y\x1c\x85z", "##$$ %%^^ {}[]", "don't we'll I'M", "\0\x01\x7f", "tab\tsep\r\nline", "<|endoftext|>", "wort " * 5000]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


def test_ids_equal_the_librarys(spark, library):
    rng = random.Random(3)
    letters = "etaoinshrdlu  ßéñ.,'!0123\n日本ab"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(1, 300))) for _ in range(200)]
    rows = [(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)] + [(3, TEXTS[5], -1, "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, words string").repartition(3)
    want = sorted([(r[0] if r[0] is not None else -1, tuple(library.encode_ordinary(r[1] or ""))) for r in rows])
    coded = byte_bpe.encode(df, PATH, PATTERN)
    back = byte_bpe.decode(coded, PATH).collect()
    assert sorted([(r.doc_id if r.doc_id is not None else -1, tuple(r.token_ids)) for r in back]) == want
    for r in back:
        assert bytes(r.decoded) == library.decode_bytes(list(r.token_ids))
    def summed(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return (doc_id if doc_id is not None else -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    sums = byte_bpe.digest(df, PATH, PATTERN).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sums) == sorted(summed(r[0], r[1]) for r in rows)


def test_small_batches_and_empty_table(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"text number {i} " * 20) for i in range(40)], "doc_id long, text string").coalesce(1)
    ranks = byte_bpe.ranks_of(PATH)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(df.withColumnRenamed("doc_id", "id").toPandas())
    monkeypatch.setattr(byte_bpe, "BATCH_CHARS", 1000)
    for kept in (10, 1_000_000):
        monkeypatch.setattr(byte_bpe, "KEPT", kept)
        cut = list(byte_bpe._numbered(iter([batch]), PATTERN, ranks))
        assert len(cut) > 5 and [i for b in cut for i in b.column("ids")[0].as_py()] == list(range(40))
        # the numbers of all rows, looked up in the words told so far, give the texts again
        words, texts = [], []
        for b in cut:
            first = b.column("first")[0].as_py()
            assert first == len(words) or (kept == 10 and first == 0)
            words[first:] = [w or f for w, f in zip(b.column("words")[0].as_py(), b.column("fold")[0].as_py())]
            sizes, numbers = np.frombuffer(b.column("sizes")[0].as_py(), np.int64), np.frombuffer(b.column("numbers")[0].as_py(), np.int32)
            texts += ["".join(words[n] for n in own) for own in np.split(numbers, np.cumsum(sizes)[:-1])]
        assert texts == batch.column("text").to_pylist()
    assert byte_bpe.digest(df.where("false"), PATH, PATTERN).count() == 0
    assert byte_bpe.encode(df.where("false"), PATH, PATTERN).count() == 0


def test_a_tasks_first_words_are_folded_once(spark, monkeypatch):
    texts = [f"etaoinshrd wxyzq{i} qqkzvb{i} " for i in range(300)]
    ranks = byte_bpe.ranks_of(PATH)
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "BATCH_CHARS", 200)
    monkeypatch.setattr(byte_bpe, "KEPT", 60)
    monkeypatch.setattr(byte_bpe, "HELD", 20)
    cut = list(byte_bpe._numbered(iter([pa.RecordBatch.from_pydict({"id": list(range(300)), "text": texts})]), PATTERN, ranks))
    told = [w for b in cut for w in b.column("fold")[0].as_py() if w]
    assert told.count("etaoinshrd") == 1
    words, found = [], []
    for b in cut:
        first = b.column("first")[0].as_py()
        assert first in (20, len(words))
        words[first:] = [w or f for w, f in zip(b.column("words")[0].as_py(), b.column("fold")[0].as_py())]
        assert len(words) < 200
        sizes, numbers = np.frombuffer(b.column("sizes")[0].as_py(), np.int64), np.frombuffer(b.column("numbers")[0].as_py(), np.int32)
        found += ["".join(words[n] for n in own) for own in np.split(numbers, np.cumsum(sizes)[:-1])]
    assert found == texts


def test_long_words_by_the_heap(library):
    ranks = byte_bpe.ranks_of(PATH)
    rng = random.Random(5)
    for alphabet in ("a", "ab", "etaoin", "日本語中文字", "01"):
        for n in (1, 2, 3, 17, 257, 3000):
            word = "".join(rng.choices(alphabet, k=n))
            assert byte_bpe.merged(word.encode(), ranks) == library._encode_single_piece(word)


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, token_ids array<int>")
    found = {r.doc_id: r.decoded for r in byte_bpe.decode(df, PATH).collect()}
    assert found[1] is None and bytes(found[2]) == b""


def test_plain_pattern_finds_the_same_words():
    rng = random.Random(5)
    full, plain = regex.compile(PATTERN).findall, byte_bpe.plain_pattern(PATTERN)
    assert plain is not None
    find = byte_bpe._finder(PATTERN, plain)
    # every character of the first plane between two words, those of white space and of marks in a row
    every = [f"a{chr(c)}{chr(c)} 1{chr(c)}'s" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    mixed = ["".join(rng.choices("etaé'stlß \n\t\x0b\x1c\x1f\x85\xa0\u2028\u3000\u0301ⅷ٣²日本,.#\U0001f600\U00020000", k=rng.randrange(60))) for _ in range(3000)]
    for text in [*every, *mixed, *(t or "" for t in TEXTS)]:
        assert find(text) == full(text)
    for odd in (r"\p{Lu}+", r"(?i:x)", r"[\S]", r"\w+", "[[a]", r"\d", r"\P{L}"):
        assert byte_bpe.plain_pattern(odd) is None
        assert byte_bpe._finder(odd, None)("Xx 1") == regex.compile(odd).findall("Xx 1")
