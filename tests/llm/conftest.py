import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table with the columns of documents and some that clash."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src1", None if t is None else len(t), "x", "y", 1) for i, t in rows],
            SCHEMA + ", chunk string, bucket string, kind int")

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random texts with exact and near copies, shared passages, short, null and repeated rows."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 6))) for _ in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(80)]
    rows = []
    for i in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 200))]
        if i % 7 == 3:
            at = rnd.randrange(len(words))
            words[at:at] = passage[rnd.randrange(10):]
        rows.append((i, rnd.choice([" ", "  ", "\n", " \t"]).join(words)))
    for i in range(60, 90):
        words = rows[i - 60][1].split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "two words"), (94, "Two words"), (None, rows[4][1]),
             (95, "ab " * 300), (4, rows[4][1]), (4, rows[5][1])]
    rnd.shuffle(rows)
    return rows
