import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target double, size string, row string, source_size int"


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, a very long one, repeats, near copies, shared passages, odd characters."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(200), say(40)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (3, 90, 150)]
    long = say(9000) + "\n" + passage + " " + say(300)
    return [
        None, "", " \n\t ", "one", "a b c d", base, base, base + "\n", *near, say(120) + " " + passage + "\n" + say(30), passage, long, long[: len(long) // 2],
        "Released under the MIT License. <|endoftext|> all rights reserved, General public LICENSE", "x" * 50_000, "é ́a<|startoftext|>b\x1cc d\xa0e don't WE'LL 12,3",
        "same line\nsame line\nother\nsame line " + say(30), " ".join(["again and again the same eight words here"] * 6), "# $ % " + say(40) + " <|> ***", *[say(rng.randint(1, 80)) for _ in range(20)],
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(None if i == 7 else i % 30, t, [None, "en", "de", "xx"][i % 4], None if i % 9 == 0 else f"s{i % 3}", None if t is None else len(t), 1.5, None, "r", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 5 > 0, 0) for i in range(25)] + [(3, None, None), (None, True, 1), (999, False, 0)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "CAST(quality AS int) quality", "toxic")


def rows(df):
    return [r.asDict() for r in df.collect()]
