import random
import re

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def awkward_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, empties, copies, near copies, repeats and very long texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage, long_one = prose(120), prose(70), prose(9000)
    near = list(base)
    near[5] = "changed"
    texts = {
        1: "a b  c\td", 2: "a b c d", 3: None, 4: "", 5: " \t\n ", 6: "A B C D", 7: "one", 8: "One",
        9: "x" * 60_000, 10: "<|endoftext|> é à 日本語 🙂 it's　 \n", 11: " ".join(base), 12: " ".join(near), 13: "\n".join(base),
        14: " ".join(prose(60) + passage + prose(40)), 15: " ".join(passage), 16: " ".join(passage + prose(80)),
        17: " ".join(long_one), 18: " ".join(long_one[:4000] + ["cut"] + long_one[4000:]), 19: "er " * 300, 20: "er " * 280,
    }
    for i in range(21, 60):
        texts[i] = " ".join(prose(rng.randint(1, 150)))
    for i in range(60, 90):
        texts[i] = " ".join(base)
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in texts.items()]
    rows += [(2, "a b c d", "en", "s2", 1), (None, "a b c d", None, None, None), (None, None, None, None, None)]
    rows += [(90, "no source at all", None, None, None), (91, "", "en", "empty", 0)]
    rng.shuffle(rows)
    return rows


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = "keep_id string, score string, size string, start string, rid string, part string, rank string, kept string, words string, version string"


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The awkward documents, with further columns whose names clash."""
    extra = (None,) * len(CLASHING.split(", "))
    return spark.createDataFrame([r + extra for r in rows], f"{FIELDS}, {CLASHING}").repartition(3, "lang")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{FIELDS}, {CLASHING}")


@pytest.fixture(scope="session")
def reference():
    from tokenizers import Tokenizer

    from terralens.llm.tokens import default_vocabulary

    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids
