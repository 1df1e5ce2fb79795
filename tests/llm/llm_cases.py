"""A small table with every awkward case, and a schema with clashing extra columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "h long, n long, r long, k long, node string, bucket string, size int, kept int, words array<string>, _s string")


def sentence(rng, n, vocabulary="abcdefghij"):
    return " ".join("".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts():
    rng = random.Random(7)
    base = [sentence(rng, n) for n in (3, 12, 40, 80, 200)]
    out = [None, "", " ", "\n\n \t", "a", "!!! ###", "A b", "é", "one two three", "ONE two three", "x" * 500, "ab " * 300]
    out += base + base[2:4]
    for k in range(8):  # near copies
        words = base[3].split()
        words[10 * k % len(words)] = f"edit{k}"
        out.append(" ".join(words))
    shared = sentence(rng, 60)
    out += [sentence(rng, 30) + "\n" + shared + "\n" + sentence(rng, 20) for _ in range(4)]
    out += ["Head line here\n" + base[1] + "\nHead line here", "head  LINE here!\n" + base[1] + " 12", base[1] + " 77\nlast"]
    out.append(sentence(rng, 4000))
    return out


def rows(fill=True):
    out = []
    for k, text in enumerate(texts()):
        lang, source = [None, "en", "fr", "de"][k % 4], [None, "s1", "s1", "s1", "s2"][k % 5]
        out.append((k * 3, text, lang, source, None, 1, 2, 3, 4, "x", "y", 5, 6, ["w"], "z"))
    out += [out[14], (None, "a null id", "en", "s1", None, 1, 2, 3, 4, "x", "y", 5, 6, ["w"], "z")]
    return out if fill else []


def docs(spark, fill=True):
    return spark.createDataFrame(rows(fill), SCHEMA).repartition(3)
