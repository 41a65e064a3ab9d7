"""Small tables with what operators must stand: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

#: Further columns under names that operators use inside.
CLASHES = "kept boolean, node long, label string, row string, _row string, size long, gone int, copies long, n_lines string, key long, of string, n long, text_hash long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def documents(seed: int = 5) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and", "to", "in"]) if rnd.random() < 0.35 else "".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120).split()
    texts = [None, "", " \t\n", "one", "Two words", "\x1c a\u0085b  c", "É " * 60, prose(80), "Cookie notice for all\n" + prose(70)]
    for edits in (0, 0, 1, 2, 4, 6, 8, 12, 20):
        copy = list(base)
        for at in rnd.sample(range(len(copy)), edits):
            copy[at] = word() + "x"
        texts.append(" ".join(copy))
    texts += [f"Shared line of a site\n{prose(60)}\nShared line of a site" for _ in range(14)]
    texts += [prose(30_000), "a b c " * 100, "<|endoftext|> it's <|startoftext|>x İΣ", texts[7], texts[7]]
    rows = []
    for i, text in enumerate(texts):
        source = None if i == 3 else f"s{i % 12}"
        rows.append((i, text, [None, "en", "fr", "xx"][i % 4] if i < 8 else "en", source, len(text or "")) + (None,) * 13)
    rows.append(rows[7])  # a repeated row
    rows.append((8, prose(55), "en", "s1", 0) + (True, 1, "l", "r", "q", 2, 3, 4, "z", 5, "o", 6, 7))  # an id used twice
    rows.append((None, prose(60), "en", "s2", 0) + (None,) * 13)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
