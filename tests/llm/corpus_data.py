"""Folders and odd rows that the corpus tests share."""

from __future__ import annotations

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "benchmark", "labels", "pages")
#: Extra columns with names that operators use themselves.
CLASHES = ("row", "key", "doc", "tag", "fp", "slot", "shard", "size", "score", "hits", "block", "placed", "words", "id", "w")

PASSAGE = " ".join(f"pass{i}" for i in range(60))
ITEM = "one two three four five six seven eight nine ten eleven twelve"
LINE = "This very line is repeated in many documents"


def documents():
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    texts = [
        (1, f"Alpha {PASSAGE} omega\n{LINE}\n"), (2, f"beta {PASSAGE} gamma\n  {LINE.upper()}\t"), (3, f"{LINE}\n{LINE}\nrest here"),
        (4, None), (5, ""), (6, " \t\n\x0b "), (7, "word"), (8, "two words"), (9, f"say {ITEM.upper()}, now"),
        (10, "short item here again"), (11, long_text), (12, long_text + " end"), (13, "same text again and again ok"),
        (14, "same text again and again ok"), (14, "same text again and again ok"), (15, "other text under"), (15, f"one id {PASSAGE}"),
        (None, f"{LINE}\nno id {PASSAGE}"), (None, None), (16, "mail bob.x@mail1.example.com or +1 (555) 123-4567, 10.0.0.255 4111 1111 1111 1111 999.1.1.1"),
        (17, "é ü — ß 漢字   x"), (18, "— … 123"), (19, "a@b.c@d.e +1+2 1.2.3.4.5.6.7.8 " + "7" * 5000), (20, "A" * 50_000),
    ]
    return [(d, t, lang, s, None if t is None else len(t)) for i, (d, t) in enumerate(texts)
            for lang, s in [(("en", "de", None)[i % 3], ("b", "a", None, "", "é")[i % 5])]]
