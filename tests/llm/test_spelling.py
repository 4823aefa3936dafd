import random
import re
import zlib
from collections import Counter

from filigree.llm import spelling
from tests.llm.helpers import frame, odd_rows, prose

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min((-n[x], x) for x in near[w])[1] if near[w] else None for w in n}
    form = {w: x if x is not None and n[x] >= 2 * n[w] else None for w, x in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def got(spark, rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, rows)).collect()}


def test_words_of_texts_against_brute_force(spark):
    rows = odd_rows() + [(100 + k, prose(k, 400) + " Été été ÉTÉ straße÷x Straße ÀÀÀÀÀ a1b2") for k in range(30)]
    assert got(spark, rows) == brute(counts(rows))
    assert got(spark, []) == {} and got(spark, [(1, None), (None, "")]) == {}


def test_dense_neighbourhoods(spark):
    """Words over three letters, so that runs, repeats, prefixes and heavy paths all meet; chains of forms."""
    r = random.Random(5)
    words = ["".join(r.choice("abß") for _ in range(r.randint(5, 8))) for _ in range(700)]
    words += ["a" * k for k in range(5, 15)] + ["aaaaab", "baaaaa", "aabaaa", "x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 149]
    rows = [(k, " ".join([w] * r.choice((3, 4, 7, 13, 27, 60)))) for k, w in enumerate(words)]
    wanted = brute(counts(rows))
    assert got(spark, rows) == wanted
    assert max(v[3] for v in wanted.values()) > 5 and any(wanted[w][1] != v[0] for w, v in wanted.items() if v[0])


def test_each_word_moves_at_few_places(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(5, 12))) for _ in range(2000)})
    light = spelling.light_edges(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    assert max(x["count"] for x in light.groupBy("word").count().collect()) <= len(words).bit_length()
