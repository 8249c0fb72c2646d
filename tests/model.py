"""A plain model of the identifier rules, written from their description, to test the expressions against."""

import re

BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN = re.compile("[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]")


def check_character(body):
    total = 0
    for place, c in enumerate(body[:14]):
        quotient, rest = divmod(BASE36.index(c) * (1 + place % 2), 36)
        total += quotient + rest
    return BASE36[-total % 36]


def checked(word):
    return word is not None and re.fullmatch("[0-9A-Z]{15}", word) is not None and check_character(word) == word[14]


def swap(c, old, new):
    return new[old.index(c)] if c in old else c


def attempt(word, z, g):
    state = {"O": "0", "I": "1", "L": "1", "S": "5", "B": "8", "Z": z, "G": g, "D": "0", "Q": "0", "T": "7"}
    digit = state | {"Z": "2"}
    letters = dict(zip("0158264739", "OISBZGATEP", strict=True))
    out = [state.get(c, c) for c in word[:2]] + [letters.get(c, c) for c in word[2:7]] + [digit.get(c, c) for c in word[7:11]] + [letters.get(word[11], word[11]), word[12], "Z" if word[13] in "2S5" else word[13], word[14]]
    fixed = "".join(out)
    return fixed if GSTIN.fullmatch(fixed) else None


def repair15(word):
    tries = [attempt(word, "7", "6"), attempt(word, "2", "6"), attempt(word, "7", "9")]
    return next((t for t in tries if checked(t)), tries[0] or tries[1])


def variants(word):
    base = word[:7] + "".join(swap(c, "OISBAZ", "015847") for c in word[7:11]) + word[11:14] + swap(word[14], "O", "0")
    for one in (word, base):
        yield one
        for start, stop, old, new in ((0, 2, "OQD0I1", "000O99"), (2, 7, "0QO58", "QOQSB"), (7, 11, "751", "239"), (11, 12, "O0QD", "QQO0"), (12, 13, "Z72S5", "2ZZ5S"), (14, 15, "0OQ", "O00")):
            for i in range(start, stop):
                if one[i] in old and (start != 7 or base[i] == one[i]):
                    yield one[:i] + swap(one[i], old, new) + one[i + 1 :]


def repair_gstin(word):
    if len(word) == 14:
        return next((r for r in map(repair15, [p + word for p in "0123"] + [word + s for s in "Z50"]) if checked(r)), None)
    if len(word) != 15:
        return None
    r = repair15(word)
    if checked(r):
        return r
    return next((v for v in variants(r or word) if checked(v) and GSTIN.fullmatch(v)), r)


def greedy(vendors):
    """Admission one by one: (arrival, keys) to the arrivals admitted."""
    held, out = set(), []
    for arrival, keys in sorted(vendors, key=lambda v: v[0]):
        if held.isdisjoint(keys):
            held.update(keys)
            out.append(arrival)
    return out
