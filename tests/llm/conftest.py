import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _id string, held_out int"


def corpus():
    """Copies, near copies, shared passages, hot lines, empty, null, short and long texts, clashing columns."""
    random.seed(5)
    alphabet = {"en": "the and ing ton er", "fr": "eau ou ère oi que", "de": "ung ich sch der ä"}

    def word(lang):
        return "".join(random.choices(alphabet[lang].split(), k=random.randint(1, 3)))

    def text(lang, n):
        words = [word(lang) + random.choice(["", "", ".", "\n"]) for _ in range(n)]
        return " ".join(words)

    passage = text("en", 40)
    base = text("en", 300)
    rows = []
    for i in range(120):
        lang = random.choice(list(alphabet))
        body = text(lang, random.randint(1, 200))
        if i % 7 == 0:
            body = body + "\n" + passage + "\n" + body[:40]
        if i % 11 == 0:
            body = base
        if i % 13 == 0:
            body = base.replace("the", "ton", i // 13)
        if i % 17 == 0:
            body += " worthless idiot"
        rows.append((i, body + "\n All Rights  Reserved \n", lang, "abc"[i % 3] if i % 5 else None, len(body)))
    rows += [
        (200, None, "en", "a", 0),
        (201, "", None, "b", 0),
        (202, " \t\n\x0b ", None, None, 0),
        (203, "1234 5678", None, "c", 9),
        (204, "spam " * 20000, "en", "a", 1),
        (205, "x" * 30000, "en", "a", 1),
        (206, "a\x1cb É é <|endoftext|> it's 12 ##", "fr", "b", 1),
        (207, "ONE", "en", "é", 1),
    ]
    return [(*r, "s", "i", 1) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark, rows):
    """Repeated rows and rows without an id."""
    extra = [rows[0], rows[0], (None, *rows[1][1:]), (None, *rows[1][1:]), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows[:10] + extra, SCHEMA)
