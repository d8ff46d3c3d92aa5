"""Texts that make trouble, as documents with columns whose names the operators use inside."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, source string, fp long, part long, n long, `rank` int, component_id long, size long, words string"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows():
    shared, long = prose(1, 80, 5000), prose(2, 30_000, 20_000)
    texts = [
        None, "", "  \n\t ", "one", "two words", "Three WORDS here", "ünïcödé \U0001f600 naïve ﬁ ß", prose(3, 200), prose(3, 200), prose(3, 200) + " tail", shared, "before " + shared + " after it", prose(4, 60) + " " + shared,
        long, long + " more", "x" * 50_000, "a\nb\nb\nc d\nc d\n", "no break space \x1c sep", "<|endoftext|> and <|im_end|>", prose(5, 49), prose(5, 50), prose(5, 51),
    ]
    out = [(i, t, ("a", "b", None, "")[i % 4]) for i, t in enumerate(texts, 10)]
    out += [out[7], out[7], (None, prose(3, 200), "a"), (5, prose(6, 300), "a"), (40, prose(6, 300), "z")]
    return [(*r, 1, 2, 3, 4, 5, 6, "w") for r in out]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)
