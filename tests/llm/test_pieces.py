import random

import pytest
import sentencepiece

from quern.llm import pieces

TEXTS = ["", " ", "  ", "Hello  world\n\tfoo ", "　日本 ☃ a\U0001f600", "a" * 60, "    lead", "x" * 3000, "ab\0c", "1234567890 http://www.example.com/a?b=c&d", "Der Übermut, l'été ñandú!! ###", "wort " * 20000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def test_ids_equal_the_librarys(spark, library):
    rng = random.Random(4)
    parts = ["th", "er", "ing", "é", "ß", " ", "  ", "un", "tion", "☃", "\n", "0", "99", "A", "▁"]
    texts = TEXTS + ["".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(400)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, None, None), (3, TEXTS[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids int")
    got = pieces.decoded(pieces.encode(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "")
        assert r.piece_ids == want
        assert r.decoded_text == (r.text or "").replace("▁", " ")
        assert r.decoded_text == library.decode(want)


def test_digest_and_empty_table(spark, library):
    df = spark.createDataFrame([(1, "naïve ☃ text")], "doc_id long, text string")
    r = pieces.digest(df).first()
    assert r.n_pieces == len(library.encode("naïve ☃ text")) and r.round_trip
    assert pieces.digest(df.where("false")).count() == 0


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "_UNITS_KEPT", 5)
    encoder = pieces.Encoder(pieces.load_model())
    for text in TEXTS:
        assert encoder.encode([text, text])[1].tolist() == library.encode(text)
