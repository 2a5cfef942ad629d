import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fp long, taken long, kept string, license string, text_ string, doc_words string, folder string, from_license string, from_similarity double, n_letters long, fail_bits long"


def make_texts(seed: int = 5, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): prose with copies, near copies, shared passages, repeated lines, odd characters."""
    rnd = random.Random(seed)
    syll = ["an", "be", "co", "dé", "eau", "fi", "go", "hi", "ñu", "ka", "lo", "mi", "no", "pa"]
    word = lambda: "".join(rnd.choices(syll, k=rnd.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    shared = text(60)
    out = []
    for i in range(n):
        t = "\n".join(text(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 6)))
        if i % 7 == 3:
            t = out[-1][1]
        if i % 7 == 5:
            t = t[: len(t) // 2] + " " + shared + " " + t[len(t) // 2 :]
        if i % 11 == 4:
            t = out[-2][1] + " extra"
        if i % 13 == 6:
            t = "\n".join([text(6)] * 8)
        out.append((i, t, f"s{i % 3}"))
    return out


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(20_000))
    odd = [
        (100, None, "s0"), (101, "", None), (102, " \n\t ", "s1"), (103, "one", "s1"), (104, "one two", None), (105, long, "s2"), (106, "a" * 5000, "s2"),
        (107, "x y z \u001c q", "s0"), (108, "#$% &&& <|end|> <|endoftext|> ok", "s0"), (109, "É é ß 🙂 🙂🙂 日本 語", "s1"), (110, "same line\nsame line\nsame line", "s1"), (None, "no id here at all", "s2"), (None, None, None),
    ]
    rows = make_texts() + odd
    rows += [rows[0], rows[0], odd[0], odd[4]]
    full = [(i, t, "en", s, None if t is None else len(t), 7, 8, 9, "kept", "mine", "t", "d", "f", "l", 0.5, 3, 1) for i, t, s in rows]
    return spark.createDataFrame(full, DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)
