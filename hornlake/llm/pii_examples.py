"""Labelled spans to train the tagger of personal data on: sentences of invented words with values of each kind."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from hornlake.llm.tagger import classes

#: Label 0 is none.
KINDS = ["email", "ip", "card", "phone"]

_ONSETS = "b c d f g h j k l m n p r s t v w z ch sh th st tr pl br qu gr".split()
_VOWELS = "a e i o u ea ou ai io ie é è ü ö ä ó".split()
_CODAS = ["", "n", "r", "s", "t", "l", "nd", "st", "ng", "m"]


class Examples:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self, ascii_only: bool = False) -> str:
        vowels = _VOWELS[:10] if ascii_only else _VOWELS
        return "".join(self.pick(_ONSETS) + self.pick(vowels) + self.pick(_CODAS) for _ in range(int(self.rng.integers(1, 4))))

    def email(self) -> str:
        name = self.pick([self.word(True), f"{self.word(True)}.{self.word(True)}", f"{self.word(True)}{self.digits(2)}", f"{self.word(True)}_{self.word(True)}", f"{self.word(True)}.{self.digits(2)}"])
        host = self.pick([self.word(True), f"mail{self.digits(1)}.{self.word(True)}", f"{self.word(True)}-{self.word(True)}", "mail.example"])
        end = self.pick(["com", "org", "net", "de", "fr", "co.uk"])
        at, dot = self.pick([("@", ".")] * 5 + [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT "), (" @ ", ".")])
        text = f"{name}{at}{host.replace('.', dot)}{dot}{end.replace('.', dot)}"
        return text.upper() if self.rng.random() < 0.1 else text

    def ip(self) -> str:
        return self.pick([".", ".", ".", "[.]", " . "]).join(str(int(x)) for x in self.rng.integers(0, 256, 4))

    def card(self) -> str:
        n = int(self.pick([13, 15, 16, 16, 16, 19]))
        body = list(map(int, self.digits(n - 1)))
        body[0] = int(self.pick([3, 4, 5, 6]))
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(body)))
        text = "".join(map(str, body)) + str(-total % 10)
        sep = self.pick(["", "", " ", "-", ".", "/"])
        return sep.join(text[i : i + 4] for i in range(0, n, 4))

    def phone(self) -> str:
        d = self.digits
        return self.pick([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(2)}-{d(3)}-{d(6)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"+{d(11)}", f"{d(3)}.{d(3)}.{d(4)}"])

    def other(self) -> str:
        d, rng = self.digits, self.rng
        return self.pick(
            [
                d(int(rng.integers(1, 6))),
                f"{d(4)}-{d(2)}-{d(2)}",
                f"{d(2)}:{d(2)}:{d(2)}",
                f"{d(2)}.{d(2)}.{d(4)}",
                f"{d(1)}.{d(1)}.{d(2)}",
                f"${d(3)},{d(3)}.{d(2)}",
                f"#{d(6)}",
                f"{d(3)}%",
                "token = \"" + "".join(self.pick("0123456789abcdef") for _ in range(40)) + '"',
                f"http://{self.word(True)}.{self.word(True)}.com/{self.word(True)}?page={d(1)}",
                f"<a href=\"/{self.word(True)}\">",
                f"@{self.word(True)}",
                f"at {self.word(True)} dot",
                f"{d(2)}-{d(3)}",
                f"ISBN {d(3)}-{d(1)}-{d(5)}",
                f"{d(4)} {self.word()} {d(4)}",
                self.word().upper() + "!!",
                self.word() + self.pick(["***", "$$$", "%%%", "###", "&&&", " |"]),
                f"{d(1)}+{d(1)}={d(2)}",
            ]
        )

    def text(self, length: int, density: float = 0.11) -> tuple[str, list[tuple[int, int, int]]]:
        """A text and its spans: start, end, label; `density` is the share of values among its parts."""
        rng, out, spans, at = self.rng, [], [], 0
        while at < length:
            x = rng.random()
            label = 0
            if x < density:
                label = int(rng.integers(1, 1 + len(KINDS)))
                part = getattr(self, KINDS[label - 1])()
            elif x < density + 0.09:
                part = self.other()
            else:
                part = self.word()
                part = part.capitalize() if rng.random() < 0.15 else part
            if label:
                spans.append((at, at + len(part), label))
            part += self.pick([" "] * 12 + [", ", ". ", ".\n", "; ", ": ", "%%% ", ".*** ", ") ", "\n", " | ", "" if not label else " "])
            out.append(part)
            at += len(part)
        return "".join(out), spans

    def batches(self, steps: int, batch: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        text, spans = self.text(steps * batch * length // 4, density=0.2)  # each stretch is seen four times, cut at other places
        x, y = classes(text), np.zeros(len(text), np.int64)
        for a, b, label in spans:
            y[a:b] = label
        for _ in range(steps):
            at = self.rng.integers(0, len(x) - length, batch)[None, :] + np.arange(length)[:, None]
            yield x[at], y[at]
