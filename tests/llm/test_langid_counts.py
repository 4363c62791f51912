"""Language identification against dictionaries of n-grams, and on workers without the library."""
import os
import random
import subprocess
import sys
import textwrap
from collections import Counter

import numpy as np
import pytest

from plotwise.llm import langid
from tests.llm import helpers as H


def plain_grams(text, n=langid.N):
    cleaned = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    framed = "  " + " ".join(cleaned.split()) + " "
    return [framed[i:i + n] for i in range(len(framed) - n + 1) if not framed[i:i + n].isspace()]


def texts(rng, n):
    stems = {"aa": ["ba", "be", "do", "ka", "x"], "bb": ["ti", "be", "shi", "no", "é"], "cc": ["lö", "äm", "gra", "do", "q"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4)))
                                 for _ in range(rng.randrange(0, 15))) + rng.choice(["", ". 12", "!"]), lang, "s", 1))
    return rows


def plain_model(rows):
    counts = {}
    for _, t, lang, *_ in rows:
        counts.setdefault(lang, Counter()).update(plain_grams(t))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    keep = {}
    for lang, c in counts.items():
        keep[lang] = {g for g, n in c.items() if n >= max(2.0, totals[lang] * langid.MIN_SHARE) and n / totals[lang] >= langid.MIN_RATIO * max(
            counts[o][g] / totals[o] for o in counts)}
    return keep


def test_counts_and_predictions_equal_dictionaries(spark):
    rng = random.Random(3)
    rows = texts(rng, 400)
    model = langid.learn(H.frame(spark, rows).repartition(5), size=1 << 22, hashes=4)
    keep = plain_model(rows)
    assert model.languages == sorted(keep)
    asked = [t for _, t, *_ in texts(rng, 200)] + ["", None, "é", "12", "Ba! be? ĿO", "zz " * 300]
    total, hits = model.counts(asked)
    for t, n, found in zip(asked, total, hits):
        grams = plain_grams(t)
        assert n == len(grams)
        want = [sum(g in keep[k] for g in grams) for k in model.languages]
        assert found == pytest.approx(want, abs=0.01)
        name, score, _ = (x[0] for x in model.predict([t]))
        if not any(map(str.isalpha, t or "")):
            assert (name, score) == ("und", 0.0)
        else:
            assert name == model.languages[int(np.argmax(want))]
            assert score == pytest.approx(max(want) / sum(want) if sum(want) else 0.0, abs=0.01)


def test_the_filter_is_at_most_half_full(spark, monkeypatch):
    rows = H.frame(spark, texts(random.Random(4), 400))
    monkeypatch.setattr(langid, "SLOTS", 16)
    model = langid.learn(rows)
    full = [float(((model.filter >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(len(model.languages))]
    assert len(model.filter) > 16 and max(full) <= 0.5
    assert float((model.filter != 0).mean()) <= 0.5
    monkeypatch.setattr(langid, "MAX_SLOTS", 64)
    with pytest.raises(ValueError):
        langid.learn(rows)


def test_sixty_four_languages(spark):
    rng = random.Random(5)
    names = [f"l{i:02d}" for i in range(64)]
    word = {k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for k in names}
    rows = [(i, f"{word[k]} {word[k]}", k, "s", 1) for i, k in enumerate(names * 3)]
    model = langid.learn(H.frame(spark, rows))
    assert model.predict([word[k] for k in names])[0] == names
    with pytest.raises(ValueError):
        langid.learn(H.frame(spark, rows + [(999, "another", "l99", "s", 1)] * 2))


def test_workers_need_no_copy_of_the_library(tmp_path):
    """The queries of operators 8, 7 and 11 run where only the driver can import them."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {repo!r})
        from plotwise.session import get_spark
        from plotwise.llm import queries
        spark = get_spark("local[2]", 2)
        for name in ("op8_bloom_language_id", "op7_token_shards", "op11_best_fit_packing", "op13_embedding_whitening"):
            print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("op") == 4
