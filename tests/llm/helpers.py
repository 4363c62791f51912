"""Small corpora with the awkward cases, and plain-Python versions to compare with."""
import collections
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=0, n=60):
    """Nulls, empty and wordless texts, a very long text, exact and near copies, repeated rows, a null id."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(8, 120), 5000) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1]]
    for base in texts[2:6]:
        w = base.split()
        for k in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = f"edit{k}"
            texts.append(" ".join(v))
    texts += [None, "", "  \n ", "!!! ...", "one", "one", "two words", "a b c d", "A, b; C d!"]
    texts.append(sentence(rng, 20_000, 9000))
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(0, texts[0], "en", "src0", 1), (3, "another text under a repeated id with some words in it", "en", None, 1),
             (None, texts[7], None, None, None)]
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that the operators use inside
        from pyspark.sql import functions as F
        for c in ("key", "node", "row", "h", "band", "keep_id", "mix_slot", "lang_pred", "words", "w", "pos", "item_id"):
            df = df.withColumn(c, F.lit("clash"))
    return df


def shingles(t, k=5):
    w = words(t)
    if 0 < len(w) < k:
        return collections.Counter([tuple(w)])
    return collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)
