"""Indian tax and bank identifiers: formats, checksum and repair of confused characters.

All are expressions on upper-case text, so they run where the rows are.  The
longer ones are SQL text over a word ``w``: built column by column, a repair
would take thousands of calls to the JVM before a query starts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import inline, sql_first, sql_let

# The formats.
PAN = "[A-Z]{5}[0-9]{4}[A-Z]"
GSTIN = "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]"
IFSC = "[A-Z]{4}0[A-Z0-9]{6}"
# What a digit is read for where a letter must be, and the other way round.
TO_LETTER = ("01582647", "OISBZGAZ")
TO_DIGIT = ("OILSBZGA", "01158264")
# The same for tax numbers, by part; digits first as Z = 7, then Z = 2, then G = 9.
GST_LETTER = ("0158264739", "OISBZGATEP")
GST_STATE = [("OILSBZGDQT", "0115876007"), ("OILSBZGDQT", "0115826007"), ("OILSBZGDQT", "0115879007")]
GST_DIGIT = [("OSIZBLGDQT", "0512816007"), ("OSIZBLGDQT", "0512816007"), ("OSIZBLGDQT", "0512819007")]
# Single swaps that are tried when the checksum fails, by part: first place, last place, from, to.
SWAPS = [(1, 2, "OQD0I1", "000O99"), (3, 7, "0QO58", "QOQSB"), (8, 11, "751", "239"), (12, 12, "O0QD", "QQO0"), (13, 13, "Z72S5", "2ZZ5S"), (15, 15, "0OQ", "O00")]
# The letters that a bank's branch codes start with.
BANK_CODES = {
    "STATE BANK OF INDIA": "SBIN",
    "HDFC BANK": "HDFC",
    "ICICI BANK": "ICIC",
    "AXIS BANK": "UTIB",
    "CANARA BANK": "CNRB",
    "PUNJAB NATIONAL BANK": "PUNB",
    "BANK OF BARODA": "BARB",
    "KOTAK MAHINDRA BANK": "KKBK",
    "INDUSIND BANK": "INDB",
    "YES BANK": "YESB",
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def is_format(text: Column, pattern: str) -> Column:
    """Whether the whole text has the format."""
    return text.rlike(f"^{pattern}$")


def _translated(word: str, start: int, size: int, old: str, new: str) -> str:
    return f"translate(substring({word}, {start}, {size}), '{old}', '{new}')"


def _if_format(fixed: str, pattern: str, also: str = "true") -> str:
    """The fixed word if it has the format, else null."""
    return sql_let(fixed, "x", f"CASE WHEN {also} AND x RLIKE '^{pattern}$' THEN x END")


def repair_pan(word: Column) -> Column:
    """A ten-character candidate with its letters and digits put right, null if that makes no PAN."""
    parts = [_translated("w", 1, 5, *TO_LETTER), _translated("w", 6, 4, *TO_DIGIT), _translated("w", 10, 1, *TO_LETTER)]
    return inline(word, f"w -> {_if_format(' || '.join(parts), PAN, 'length(w) = 10')}")


def repair_ifsc(word: Column) -> Column:
    """An eleven-character candidate put right: letters, then 0, then O as 0."""
    parts = [_translated("w", 1, 4, *TO_LETTER), _translated("w", 5, 1, "ODQUCG", "000000"), _translated("w", 6, 6, "O", "0")]
    return inline(word, f"w -> {_if_format(' || '.join(parts), IFSC, 'length(w) = 11')}")


def bank_code(name: Column) -> Column:
    """The code of a bank, null if it is not known."""
    codes = F.create_map(*[F.lit(x) for pair in BANK_CODES.items() for x in pair])
    return F.try_element_at(codes, F.upper(name))


def _check(body: str) -> str:
    """The check character of the first 14 characters: base 36, every second one doubled, digits of the products added."""
    digit = f"(instr('{DIGITS}', substring({body}, place, 1)) - 1) * (2 - place % 2)"
    total = f"aggregate(sequence(1, 14), 0L, (total, place) -> total + {sql_let(digit, 'product', 'product div 36 + product % 36')})"
    return f"substring('{DIGITS}', CAST((36 - {total} % 36) % 36 + 1 AS INT), 1)"


def _checked(word: str) -> str:
    return f"coalesce({word} RLIKE '^[0-9A-Z]{{15}}$' AND {_check(word)} = substring({word}, 15, 1), false)"


def check_character(body: Column) -> Column:
    return inline(body, f"w -> {_check('w')}")


def has_checksum(gstin: Column) -> Column:
    """Whether 15 characters end with their check character; anything else has none."""
    return inline(gstin, f"w -> {_checked('w')}")


def with_checksum(gstin: Column) -> Column:
    """The number with the check character that it should have, null if that is not the format."""
    fixed = f"substring(w, 1, 14) || {_check('w')}"
    return inline(gstin, f"w -> {_if_format(fixed, GSTIN, chr(39).join(('length(w) >= 14 AND w RLIKE ', '^[0-9A-Z]*$', '')))}")


def _attempt(word: str, mode: int) -> str:
    """One repair of 15 characters, null if it does not make the format."""
    parts = [
        _translated(word, 1, 2, *GST_STATE[mode]), _translated(word, 3, 5, *GST_LETTER), _translated(word, 8, 4, *GST_DIGIT[mode]), _translated(word, 12, 1, *GST_LETTER),
        f"substring({word}, 13, 1)", _translated(word, 14, 1, "2S5", "ZZZ"), f"substring({word}, 15, 1)",
    ]
    return _if_format(" || ".join(parts), GSTIN)


def _repaired(word: str) -> str:
    """15 characters repaired: the first attempt with a checksum, else the first that has the format."""
    tries = f"array({', '.join(_attempt(word, mode) for mode in range(3))})"
    return sql_let(tries, "tries", f"coalesce({sql_first('tries', 't', f'CASE WHEN {_checked("t")} THEN t END')}, tries[0], tries[1])")


def _variants(word: str) -> str:
    base = f"substring({word}, 1, 7) || {_translated(word, 8, 4, 'OISBAZ', '015847')} || substring({word}, 12, 3) || {_translated(word, 15, 1, 'O', '0')}"

    def swapped(one: str) -> str:
        out = [one]
        for start, stop, old, new in SWAPS:
            for i in range(start, stop + 1):
                now, apt = f"substring({one}, {i}, 1)", _translated(one, i, 1, old, new)
                fits = f"{apt} <> {now}" + (f" AND {now} = substring(base, {i}, 1)" if start == 8 else "")
                out.append(f"CASE WHEN {fits} THEN substring({one}, 1, {i - 1}) || {apt} || substring({one}, {i + 1}, 15) END")
        return ", ".join(out)

    return sql_let(base, "base", f"filter(array({swapped(word)}, {swapped('base')}), y -> y IS NOT NULL)")


def variants(word: Column) -> Column:
    """The word, then each single swap in it; then the same for the word with its digits put right."""
    return inline(word, f"w -> {_variants('w')}")


def repair_gstin(word: Column) -> Column:
    """A candidate of 14 or 15 characters repaired, null if hopeless.

    With 14 the lost first or last character is guessed, and the checksum must
    hold.  With 15 a repair with a checksum is preferred, then a variant with
    one, then a repair without.
    """
    guesses = "array(" + ", ".join([*(f"'{p}' || w" for p in "0123"), *(f"w || '{s}'" for s in "Z50")]) + ")"
    short = sql_first(guesses, "g", sql_let(_repaired("g"), "r", f"CASE WHEN {_checked('r')} THEN r END"))
    varied = sql_let("coalesce(r, w)", "v", sql_first(_variants("v"), "z", f"CASE WHEN {_checked('z')} AND z RLIKE '^{GSTIN}$' THEN z END"))
    long = sql_let(_repaired("w"), "r", f"CASE WHEN {_checked('r')} THEN r ELSE coalesce({varied}, r) END")
    return inline(word, f"w -> CASE WHEN length(w) = 14 THEN {short} WHEN length(w) = 15 THEN {long} END")
