TEXTS = [
    "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.",
    "", None, "   \n\t ", "a", "Straße naïve 漢字 🙂 l'été\r\nzweite Zeile", "x" * 30_000,
    "one two three four five six seven eight nine ten\n" * 400, "<|endoftext|> don't  stop\x00 1234",
]
