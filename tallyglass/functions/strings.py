"""Small string tools of corpora, manifests and logs; all column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import RAW_VALUES, field_match, normalize

#: The ways a field's label is written.
LABELS = {
    "ssn": ["SSN:", "SSN -", "Social Security No.", "Social Security Number:", "SSN #"],
    "phone": ["Phone:", "Tel.", "Phone -", "Contact No.", "Ph:", "Telephone:"],
    "credit_card": ["Card Number:", "Card No.", "CC:", "Payment Card -", "Account Card:"],
    "email": ["Email:", "E-mail -", "Contact Email:", "Mail:"],
    "name": ["Name:", "Full Name:", "Name -", "Employee:"],
    "address": ["Address:", "Mailing Address:", "Addr.", "Address -"],
}


#: How a target of each field stands in training text, in the order of a whole record.
TARGET_FORMATS = {"name": "{name}", "ssn": "SSN: {ssn}", "email": "Email: {email}", "phone": "Phone: {phone}", "address": "{address}", "credit_card": "{credit_card}"}


def format_target(values: dict[str, Column], field: str | None = None) -> Column:
    """A field's value with its label; without a field, or for one that has no format, the whole record, a line for each field it has. Null where nothing is known."""
    line = lambda f: F.concat(F.lit(TARGET_FORMATS[f].split("{")[0]), values[f])
    if field in TARGET_FORMATS:
        return line(field)
    lines = F.array_compact(F.array(*[line(f) for f in TARGET_FORMATS if f in values]))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def chosen(options: list[str], *keys: Column | str) -> Column:
    """One of the options by the hash of the keys."""
    return F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(*keys), F.lit(len(options))).cast("int"))


def partial_match(generation: Column, values: dict[str, Column], threshold: float = 0.5, rule: str = "v2") -> Column:
    """Whether at least ``threshold`` of the fields that have a value are found; fields without one don't count."""
    has = {f: F.coalesce(v != "", F.lit(False)) for f, v in values.items()}
    found = [(has[f] & field_match(F.lit(f), generation, v, rule)).cast("int") for f, v in values.items()]
    total = reduce(Column.__add__, [h.cast("int") for h in has.values()])
    return reduce(Column.__add__, found) / F.greatest(total, F.lit(1)).cast("double") >= threshold


def mail_sender(text: Column) -> dict[str, Column]:
    """email (lower case) and name of a message's first From line that says anything. The name is the words of letters, dots and hyphens just before the bracket, two at least; else it is made of the address's local part. Null where there is no address."""
    said = F.transform(F.filter(F.split(text, "\r?\n"), lambda line: F.startswith(line, F.lit("From:"))), lambda line: F.trim(F.substr(line, F.lit(len("From:") + 1))))
    line = F.coalesce(F.get(F.filter(said, lambda x: x != ""), F.lit(0)), F.lit(""))
    email = F.lower(F.regexp_extract(line, RAW_VALUES["email"], 0))
    before = F.when(F.contains(line, F.lit("<")), F.regexp_replace(F.substring_index(line, "<", 1), r'^[\s"]+|[\s"]+$', "")).otherwise("")
    none = F.array().cast("array<string>")
    last = F.aggregate(F.split(before, r"[\s\"]+"), none, lambda words, w: F.when(F.regexp_like(w, F.lit("^[A-Za-z][A-Za-z.-]+$")), F.concat(words, F.array(w))).otherwise(none))
    local = F.initcap(F.translate(F.split_part(email, F.lit("@"), F.lit(1)), "._", "  "))
    known = email != ""
    return {"email": F.when(known, email), "name": F.when(known, F.when(F.size(last) > 1, F.array_join(last, " ")).otherwise(local))}


def long_phones(text: Column) -> Column:
    """Distinct phone numbers of ten digits or more, sorted."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(RAW_VALUES["phone"]), F.lit(0)), F.trim)
    return F.array_sort(F.array_distinct(F.filter(hits, lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= 10)))


def vary_case(value: Column, *keys: Column | str) -> Column:
    """The value as it is, in capitals, in small letters or with capital initials, by the hash of the keys."""
    style = F.pmod(F.xxhash64(*keys), F.lit(4))
    return F.when(style == 1, F.upper(value)).when(style == 2, F.lower(value)).when(style == 3, F.initcap(value)).otherwise(value)


def vary_labels(text: Column, *keys: Column | str) -> Column:
    """Each line that begins with a field's label, or with one word more before it, gets another label of that field, by the hash of the keys; values stay."""
    # Labels are marked first, so that no label that was put in is met again.
    for field, labels in LABELS.items():
        known = "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
        text = F.regexp_replace(text, f"(?m)^(?:[A-Z][a-z]+ )?(?:{known}) ", f"\x01{field}\x02")
    for field, labels in LABELS.items():
        text = F.replace(text, F.lit(f"\x01{field}\x02"), F.concat(chosen(labels, F.lit(field), *keys), F.lit(" ")))
    return text


#: How many digits each group of a number of so many digits has.
GROUPS = {9: (3, 2, 4), 10: (3, 3, 4), 11: (1, 3, 3, 4), 16: (4, 4, 4, 4)}


def vary_number(value: Column, *keys: Column | str) -> Column:
    """A number written in another way with the same digits, by the hash of the keys: as it is, digits alone, in groups with blanks, hyphens or dots, or with blanks for its own separators.

    Numbers of a length without groups of its own (``GROUPS``) are one group. Values without digits stay.
    """
    digits = F.regexp_replace(value, r"\D", "")

    def grouped(separator: str) -> Column:
        out = digits
        for n, sizes in GROUPS.items():
            pattern, shape = "".join(f"(\\d{{{k}}})" for k in sizes), separator.join(f"${i + 1}" for i in range(len(sizes)))
            out = F.when(F.length(digits) == n, F.regexp_replace(digits, f"^{pattern}$", shape)).otherwise(out)
        return out

    own = F.regexp_replace(F.regexp_replace(value, r"\D+", " "), r"^ | $", "")
    styles = [value, digits, grouped(" "), grouped("-"), grouped("."), own]
    style = F.pmod(F.xxhash64(*keys), F.lit(len(styles)))
    out = styles[0]
    for i, c in enumerate(styles[1:], 1):
        out = F.when(style == i, c).otherwise(out)
    return F.when(digits == "", value).otherwise(out)


def company_domain(company: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(F.lower(company), "[ ,]", ""), 1, 12), F.lit(".com"))


def split_at(text: Column, share: Column) -> tuple[Column, Column]:
    """Prefix and suffix: the prefix has that share of the characters, one at least."""
    cut = F.greatest(F.lit(1), F.floor(F.length(text) * share).cast("int"))
    return F.substr(text, F.lit(1), cut), F.substr(text, cut + 1)


def suffix_recovered(output: Column, suffix: Column) -> Column:
    return F.coalesce(F.contains(normalize(output), normalize(suffix)), F.lit(False))


def context_before(text: Column, value: Column, width: int) -> Column:
    """The characters just before the value's first place; null where it isn't in the text."""
    at = F.position(value, text)
    return F.when(at > 0, F.substr(text, F.greatest(F.lit(1), at - width), F.least(F.lit(width), at - 1)))


def is_hex_digest(c: Column, length: int) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(f"^[0-9a-f]{{{length}}}$")), F.lit(False))


def word_list(c: Column) -> Column:
    """The words of a list written with commas or blanks; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[,\s]+"), lambda x: x != "")


def int_list(c: Column) -> Column:
    return F.transform(word_list(c), lambda x: x.cast("long"))


def shard_stem(name: Column) -> dict[str, Column]:
    """seed and capacity_k of a shard's file name, null where it names none."""
    number = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit("")).cast("long")
    return {"seed": number(r"_(\d+)_(?:[^/]*_)?k\d+"), "capacity_k": number(r"_k(\d+)(?:\.[a-z]+)?$")}


def safe_name(c: Column) -> Column:
    """For file names: everything but letters, digits, dots, hyphens and underscores becomes a hyphen."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._\-]+", "-")


def passes_check_digit(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def invalid_card(*keys: Column | str) -> Column:
    """A card number of sixteen digits by the hash of the keys that fails the check-digit test, so no card has it."""
    body = F.concat(F.lit("4"), F.lpad(F.pmod(F.xxhash64(*keys), F.lit(10**15)).cast("string"), 15, "0"))
    last = (F.substring(body, 16, 1).cast("int") + 1) % 10
    number = F.when(passes_check_digit(body), F.concat(F.substring(body, 1, 15), last.cast("string"))).otherwise(body)
    return F.concat_ws("-", *[F.substring(number, i, 4) for i in (1, 5, 9, 13)])
