"""A small corpus with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, block int, part string, sig string"


def corpus(seed=1, n=60):
    """Rows (doc_id, text, and columns whose names clash): near and exact
    copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "ß", "é", "an", "Re"]) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = say(30)
    base = say(80)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            texts.append(say(rng.randint(1, 120)))
        elif kind == 1:
            own = base.split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        elif kind == 2:
            texts.append(say(20) + "\n" + passage + "\n" + say(20))
        elif kind == 3:
            texts.append(base.upper() if rng.random() < 0.5 else base)
        elif kind == 4:
            texts.append(" ".join([rng.choice(words)] * rng.randint(1, 60)))
        else:
            texts.append(say(3) + "\t \x0b" + say(rng.randint(1, 4)))
    texts += [None, "", "   \n", "a", "a b c", "A B C", "x" * 49, "x" * 50, "x" * 200, "ä" * 300, say(9000), "\x00odd\x1c bytes", "it's a <|endoftext|> x1y2"]
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], rows[1], (rows[2][0], say(40)), (rows[3][0], base), (None, base), (None, None), (-5, passage)]
    return [(i, t, 7, "p", None) for i, t in rows]
