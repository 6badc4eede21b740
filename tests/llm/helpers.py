"""Small texts and plain Python versions of what the operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def sample_texts(seed=3, n=60):
    """Prose, exact and near copies, shared passages, odd white space, long, short, empty and null texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", ".", ","]) for _ in range(k))
    passage = prose(70)
    texts = [prose(r.randint(5, 220)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1].upper(), texts[2] + " tail", "  " + texts[3].replace(" ", "\n\t ")]
    texts += [prose(40) + " " + passage + " " + prose(30) for _ in range(6)]
    base = prose(150).split()
    for k in range(8):
        copy = base[:]
        copy[17 * k] = "changed"
        texts.append(" ".join(copy))
    texts += ["word " * 400, prose(4000), "", None, " \n ", "one", "two words", "don't stop", "日本語 テキスト émoji 😀 ok",
              "x" * 5000, "a <|endoftext|> b<|startoftext|>c", "non breaking　space ​ joined", "tabs\t\tand  spaces   \n\n end "]
    return texts


def rows(texts=None):
    texts = sample_texts() if texts is None else texts
    return [(k * 3 + 1, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
