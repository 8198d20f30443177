import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tagloom.functions import labels, stopwords, text


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, cleaned",
    [
        ("See HTTP://a.b/c the 12 x_y, É²!", "see the  x_y é²"),
        ("a\t\n b c", "a b c"),
        ("one 1 two", "one  two"),
        ("x\x1cy\x85z w", "x y z w"),
        ("٣ Äpfel", " äpfel"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, raw, cleaned):
    assert one(spark, raw, text.clean_text) == cleaned


def test_one_pass_equals_the_single_steps(spark):
    raw = "A1b,2 http://x.y/z?q=1 \t c²Ⅷ—٣ _d  e!"
    steps = lambda c: text.remove_punctuation(
        text.remove_digits(text.collapse_whitespace(text.remove_links(F.lower(c))))
    )
    assert one(spark, raw, text.clean_text) == one(spark, raw, steps)


@pytest.mark.parametrize(
    "raw, key", [("Müller, A. B.; O'Neil", "mülleroneil"), ("De Vries, J.", "devries"), ("x", ""), (None, None)]
)
def test_clean_author(spark, raw, key):
    assert one(spark, raw, text.clean_author) == key


@pytest.mark.parametrize("raw, label", [("SDG4.00", 4), ("SDG10.00", 10), ("bad", None), (None, None)])
def test_parse_label(spark, raw, label):
    assert one(spark, raw, text.parse_label) == label


@pytest.mark.parametrize(
    "title, kept, compat",
    [
        ("Why? Because.", "Why", "Why"),
        ("No mark", "No mark", "No mar"),
        (".x", "", ""),
        ("", "", ""),
        (None, None, None),
    ],
)
def test_extract_title(spark, title, kept, compat):
    assert one(spark, title, text.extract_title) == kept
    assert one(spark, title, lambda c: text.extract_title(c, strict_compat=True)) == compat


def test_join_title_is_null_when_a_part_is(spark):
    rows = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "t string, a string")
    assert [r[0] for r in rows.select(text.join_title(F.col("t"), F.col("a"))).collect()] == ["a. b", None, None]


@pytest.mark.parametrize("raw, line", [('""a"b""', 'a"b'), ('"x"\n', "x"), ('x"\n"\n', "x"), ('""', "")])
def test_strip_quotes(spark, raw, line):
    assert one(spark, raw, text.strip_quotes) == line


@pytest.mark.parametrize(
    "raw, tokens",
    [
        ("", []),
        ("  a  b ", ["a", "b"]),
        ("cannot", ["can", "not"]),
        ("gimme gonna gotta lemme wanna", "gim me gon na got ta lem me wan na".split()),
        ("cannots x_cannot cannot_x scannot", ["cannots", "x_cannot", "cannot_x", "scannot"]),
    ],
)
def test_tokenize(spark, raw, tokens):
    assert one(spark, raw, text.tokenize) == tokens


def test_stopwords(spark):
    assert len(stopwords.ENGLISH) == len(set(stopwords.ENGLISH)) == 179
    assert one(spark, ["the", "cat", "the", "cat"], text.remove_stopwords, "array<string>") == ["cat", "cat"]
    assert one(spark, ["The"], text.remove_stopwords, "array<string>") == ["The"]
    assert one(spark, "We cannot; see 3 cats!", text.clean_tokens) == ["see", "cats"]


@pytest.mark.parametrize("printed, tokens", [("['a', 'b']", ["'a'", "'b'"]), ("[]", [""])])
def test_parse_token_list(spark, printed, tokens):
    assert one(spark, printed, text.parse_token_list) == tokens


@pytest.mark.parametrize(
    "n, grams", [(1, ["a", "b", "c"]), (2, ["a b", "b c"]), (3, ["a b c"]), (4, [])]
)
def test_ngrams(spark, n, grams):
    assert one(spark, ["a", "b", "c"], lambda c: text.ngrams(c, n), "array<string>") == grams


def test_char_ngrams(spark):
    assert one(spark, "a😀bé\n", text.char_ngrams) == ["a😀b", "😀bé", "bé\n"]
    assert one(spark, "ab", text.char_ngrams) == []


@pytest.mark.parametrize(
    "length, expected",
    [(200, [(0, 128), (96, 104)]), (90, [(0, 90)]), (250, [(0, 128), (96, 128), (192, 58)]), (128, [(0, 128)]), (0, [(0, 0)])],
)
def test_spans(spark, length, expected):
    tokens = [str(i) for i in range(length)]
    spans = one(spark, tokens, text.spans, "array<string>")
    assert [(s["start"], len(s["tokens"])) for s in spans] == expected
    assert all(s["tokens"] == tokens[s["start"] : s["start"] + 128] for s in spans)


@pytest.mark.parametrize("label, name", [(1, "sdg_01"), (9, "sdg_09"), (10, "sdg_10"), (-1, "sdg_-1"), (0, "sdg_00")])
def test_label_name(spark, label, name):
    assert one(spark, label, labels.label_name, "int") == name


def test_label_map(spark):
    assert one(spark, 2, lambda c: labels.label_map(c, [1, 2, 3]), "int") == {"1": 0, "2": 1, "3": 0}
    assert one(spark, 9, lambda c: labels.label_map(c, [1, 2]), "int") == {"1": 0, "2": 0}
    assert one(spark, None, lambda c: labels.label_map(c, [1, 2]), "int") == {"1": 0, "2": 0}


def test_argmax_takes_the_first_maximum(spark):
    best = one(spark, [0.4, 0.4, 0.2], lambda c: labels.argmax_array(c, [5, 6, 7]), "array<double>")
    assert tuple(best) == (5, 0.4)
    as_map = spark.sql("select map('b', 0.4D, 'a', 0.4D, 'c', 0.2D) as v")
    assert tuple(as_map.select(labels.argmax_map(F.col("v"))).first()[0]) == ("b", 0.4)


def test_predictions_table_matches_by_key(spark):
    docs = spark.createDataFrame([(7, "x", 1), (3, "y", 2)], "row_id int, abstract string, sdg int")
    probs = spark.createDataFrame([(3, [0.1, 0.9]), (7, [0.8, 0.2])], "row_id int, probs array<double>")
    rows = {r["row_id"]: r for r in labels.predictions_table(docs, probs, [1, 2]).collect()}
    assert (rows[7]["label"], rows[7]["prediction"], rows[7]["probability"]) == (1, 1, 0.8)
    assert (rows[3]["abstract"], rows[3]["prediction"]) == ("y", 2)


def plain_clean(raw):
    """What cleaning means, with Python's own character classes."""
    lowered = re.sub(r"http[^\s]+", "", raw.lower())
    return "".join(c for c in re.sub(r"\s+", " ", lowered) if not re.fullmatch(r"\d", c) and re.fullmatch(r"[\w\s]", c))


def plain_author(raw):
    names = "".join(c for c in raw.lower() if re.fullmatch(r"[\w\s]", c))
    return "".join(name for name in names.split() if len(name) > 1)


def test_cleaning_equals_python_on_random_unicode(spark):
    rng = random.Random(11)
    # the JVM knows fewer of the characters that Unicode added later
    letters = [chr(i) for i in range(1, 0x530) if unicodedata.category(chr(i)) != "Cn"]
    common = list("ab yz  \t\n09_.,;:http/!") + ["http://", "²", "é", "Σ", "İ", "\xa0", "\u2028", "\u3000"]
    texts = ["".join(rng.choice(common if rng.random() < 0.7 else letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", text.clean_text(F.col("t")).alias("c"), text.clean_author(F.col("t")).alias("a")).collect()
    for row in got:
        raw = texts[row["i"]]
        assert row["c"] == plain_clean(raw), ascii(raw)
        assert row["a"] == plain_author(raw), ascii(raw)
