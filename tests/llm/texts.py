"""Awkward texts that every operator meets in its tests."""

AWKWARD = [
    None,
    "",
    " ",
    "\n\n",
    "a",
    "two  spaces and\ttab \n new\r\nlines \x0b\x0c end ",
    " leading and trailing ",
    "it's we're I'll don't THEY'VE x'd !'s",
    "café café École naïve ǅ ẞ İstanbul",
    "你好世界 ЖУК हिन्दी \U0001f600\U0001f468‍\U0001f469   x\u0085y\x1cz",
    "<|endoftext|> in a text <|startoftext|>x<|endoftext|>",
    "x" * 3000,
    "ab" * 900 + " " + "é" * 500 + "0123456789" * 60,
    "word " * 5000,
    "-" * 700 + "!?" * 300,
    "repeat this line\nrepeat this line\nrepeat this line\nother",
    "́ starts with a mark ́́",
]
