"""Line rules against a plain version, and awkward rows."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from passages.llm.line_rules import BOILERPLATE, clean_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    bad = []
    for line in lines:
        n = len(WORD.findall(line))
        bare = line.rstrip(" \t\n\x0b\x0c\r\"')]»“”’")
        signs = len(re.findall(r"(?:[!?]{2}|[#*$%&|<>]{2})(?=[\x20\x09-\x0D]|\Z)", line))
        marks = len(re.findall("[|>«»•→]", line))
        bad.append(
            not bare.endswith((".", "!", "?", ":", "…")) or 5 * signs > n or (marks >= 3 and 4 * marks >= n) or any(p in line.lower() for p in BOILERPLATE)
        )
    lost = sum(len(WORD.findall(x)) for x, b in zip(lines, bad) if b)
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    kept = not base and 100 * lost <= 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines), sum(bad),
        len(words) - lost, "\n".join(x for x, b in zip(lines, bad) if not b), base, kept,
    )


def results(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in clean_lines(docs).orderBy("doc_id").collect()]


def text_of(draw):
    pool = ["a", "bé", "c.", "d!!", "e?", "x%%%", "|", "»", "log", "in", "\n", "\n", "\t", " ", "f.\"", "ß…"]
    return " ".join(draw.choice(pool) for _ in range(draw.randint(0, 120)))


def test_same_as_plain(spark):
    draw = random.Random(5)
    texts = [None, "", " \n\t", "\n", "a\n" * 40, "one two three four five six seven eight. " * 9] + [text_of(draw) for _ in range(150)]
    texts += [" ".join(f"w{draw.randint(0, 3)}" for _ in range(60)) + "." for _ in range(30)]
    assert results(spark, texts) == [plain(t) for t in texts]


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab.!|%\n\t \x0b\r\x85 é", max_size=80), min_size=1, max_size=30))
def test_any_characters(spark, texts):
    assert results(spark, texts) == [plain(t) for t in texts]


def test_long_text(spark):
    line = "A long line of plain words that ends as it should do."
    text = "\n".join(f"{line[:-1]} {i}." for i in range(20_000)) + "\nHome | About | Contact | Help"
    got = results(spark, [text, text.replace("\n", " ")])
    assert got[0][5:8] == (20_001, 1, got[0][0] - 7) and got[0][-2:] == (True, False)  # the windows of the shared words repeat
    assert got[1][4] == got[0][4]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(None, "x", 1, "t"), (3, None, 2, None), (3, None, 2, None)], "doc_id long, text string, n_words long, _text string")
    got = clean_lines(docs).collect()
    assert len(got) == 3 and sorted(r["n_words"] for r in got) == [0, 0, 1] and not any(r["kept"] for r in got)
    assert clean_lines(docs.limit(0)).count() == 0
