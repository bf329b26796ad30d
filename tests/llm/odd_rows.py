"""Small inputs that the tests share."""

SF = "/root/testdata/sf0.001"
CARD = "4012888888881881"
PROSE = (
    "The quick brown fox jumps over the lazy dog while seven wizards quietly box with liquid jugs of amber"
    " and twelve monks pack five dozen more crates of vexing paper near the old harbour wall at dawn")


def odd_documents():
    """(doc_id, text): copies, near copies, ties, empty, null and very long texts, null and repeated ids."""
    words = PROSE.split()
    rows = [
        (5, PROSE), (3, PROSE), (9, PROSE.upper()), (4, PROSE + " extra"), (6, " ".join(words[3:] + ["tail"])),
        (7, ""), (8, None), (10, " \t\n "), (11, "one two"), (12, "ONE  two"), (13, "one two three four five"),
        (1, PROSE), (1, PROSE), (None, "nobody knows this text at all"), (None, None), (14, "é" * 300), (15, "é" * 301),
        (16, "ab " * 5000), (17, " ".join(f"w{i * i % 997}" for i in range(12000))),
        (18, f"call +1 (269) 555-3296 {CARD} or write x.y@mail.example.org from 10.0.0.255."),
        (19, f"{CARD} {CARD}"), (20, "| \\ <|turn|> </turn>"), (2, " ".join(words[:20] + ["changed"] + words[21:])),
    ]
    return rows


CLASH = ["__id", "__text", "__key", "score", "bucket", "class", "spans", "piece", "n_tokens", "source_", "__pass", "rest"]
