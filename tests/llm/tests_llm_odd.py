"""Documents with everything that may go wrong, and columns named like internal ones."""

import random

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split()
FIELDS = ("doc_id long, text string, source string, n_chars long, key string, block long, "
          "class_id long, n_removed int, rank int, _row string, sig string")


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def prose(rng, sentences):
    return " ".join(sentence(rng, rng.randint(6, 14)) for _ in range(sentences))


def rows(seed=1, n=40):
    """Ids 0..n-1: random texts, near copies, copies; then null, empty and very long ones."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if i % 4 == 1:
            words = texts[-1].split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif i % 8 == 2:
            texts.append(texts[-2])
        else:
            texts.append(prose(rng, rng.randint(3, 12)))
    texts += [None, "", " \t\n ", "one two", "One TWO", prose(rng, 3000), "ünïcode ß 日本 \x1c end"]
    out = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[0], "s1"), (None, None, None)]
    return out


def frame(spark, data):
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), "k", 7, 8, 9, 1, "r", "s") for r in data], FIELDS)
