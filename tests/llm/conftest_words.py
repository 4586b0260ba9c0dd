import random

SYLLABLES = "ba ke li mo nu ra se ti vo zu".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


def mutate(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    words = text.split()
    for _ in range(max(1, int(share * len(words)))):
        words[r.randrange(len(words))] = f"new{r.randrange(1000)}"
    return " ".join(words)
