"""Texts with the cases that every operator must bear."""

from __future__ import annotations

import random


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz éa ßb".split()) + str(rng.randrange(30)) for _ in range(n))


def hard_texts() -> list[str | None]:
    """Null, empty, white space, short, long, copies, near copies, and odd characters."""
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (20, 150, 290)]
    passage = prose(rng, 60)
    return [
        None, "", " \t\n", "one", "two words", "A B c D", base, base, base.upper(), *near,
        f"{prose(rng, 50)} {passage} {prose(rng, 40)}", f"{passage}\n{prose(rng, 30)}", "same " * 200, "same " * 80,
        prose(rng, 5000), " lead  double \n\n line\ttab\x0bvt\x0cff trail ", "nbsp here wide \x1c\x85 😀 é",
        "<|endoftext|> x <|endoftext|>y it's 12,5 ''s", *[prose(rng, rng.randrange(1, 120)) for _ in range(25)],
    ]
