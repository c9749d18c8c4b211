"""Features of prompts and texts, in built-in functions but for the compressed size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.registry import Registry
from tallyglass.functions.text import once, zlib_ratio

#: Words that tell a prompt that asks for data from others.
ACTION_VERBS = "show list reveal print output display tell give provide return dump extract get fetch retrieve expose leak share".split()
DOMAIN_KEYWORDS = "email ssn phone address name record personal data information credit card account social security number private pii identity password confidential".split()
FUNCTION_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can that which who whom whose this these those it its "
    "if then than when where while although because since for of in on at to from by with about between"
).split()

LONG_TOKEN = 15


def tokens(c: Column) -> Column:
    """What stands between white space of any script."""
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")


def _share(part: Column, n: Column) -> Column:
    return F.round(part.cast("double") / F.greatest(n, F.lit(1)), 9)


def _among(lowered: Column, words: list[str]) -> Column:
    return F.size(F.filter(lowered, lambda x: x.isin(*words)))


def prompt_signals(c: Column) -> dict[str, Column]:
    """Eight features of a prompt: repeated tokens, action verbs, rare tokens, domain keywords, function words (as shares), mean token length, distinct share, tokens (1 at least)."""
    shares = {
        "token_repetition": lambda w, s, l: F.size(F.filter(s, lambda x, i: (x == F.get(s, i - 1)) | (x == F.get(s, i + 1)))),
        "action_verb_ratio": lambda w, s, l: _among(l, ACTION_VERBS),
        "rare_token_ratio": lambda w, s, l: F.size(F.filter(w, lambda x: (F.length(x) != F.octet_length(x)) | (F.length(x) > LONG_TOKEN) | ~F.regexp_like(x, F.lit(r"\p{L}")))),
        "domain_keyword_density": lambda w, s, l: _among(l, DOMAIN_KEYWORDS),
        "function_word_ratio": lambda w, s, l: _among(l, FUNCTION_WORDS),
        "avg_token_length": lambda w, s, l: F.length(F.array_join(w, "")),
        "unique_token_ratio": lambda w, s, l: F.size(F.array_distinct(l)),
    }
    every = lambda w, s, l: F.struct(*[_share(f(w, s, l), F.size(w)).alias(k) for k, f in shares.items()], F.greatest(F.size(w), F.lit(1)).cast("long").alias("n_tokens"))
    # tokens, equal ones side by side, and in lower case: each made once for a text
    made = once(tokens(F.coalesce(c, F.lit(""))), lambda w: once(F.sort_array(w), lambda s: once(F.transform(w, F.lower), lambda l: every(w, s, l))))
    return {k: made[k] for k in [*shares, "n_tokens"]}


def text_signals(c: Column) -> dict[str, Column]:
    """Lexical and structural features that need no language model: tokens, distinct share, mean length, capitalised share, characters neither letter, digit nor blank, digits, compressed share and bits a byte."""
    t = F.coalesce(c, F.lit(""))
    w = tokens(t)
    n, chars = F.size(w), F.length(t)
    odd = F.length(F.regexp_replace(t, r"(?U)[\p{L}\p{N}\s\x1c-\x1f]", ""))
    digits = chars - F.length(F.regexp_replace(t, r"\p{Nd}", ""))
    packed = zlib_ratio(c)
    return {
        "n_tokens": n.cast("long"),
        "type_token_ratio": _share(F.size(F.array_distinct(F.transform(w, F.lower))), n),
        "avg_token_length": _share(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), n),
        "capitalised_ratio": _share(F.size(F.filter(w, lambda x: F.regexp_like(x, F.lit(r"^\p{Lu}")))), n),
        "special_char_ratio": _share(odd, chars),
        "digit_ratio": _share(digits, chars),
        "compression_ratio": packed,
        "entropy_estimate": packed * 8,
    }


#: Features of a text by provider: a function of the text's column that gives named columns.
PROVIDERS: Registry[Callable[[Column], dict[str, Column]]] = Registry("feature provider")
PROVIDERS.register("prompt_signals", prompt_signals)
PROVIDERS.register("text_signals", text_signals)


def provided(text: Column, *names: str) -> list[Column]:
    """The features of the named providers, or of all, as ``<provider>_<feature>``."""
    return [c.alias(f"{name}_{feature}") for name in names or PROVIDERS for feature, c in PROVIDERS[name](text).items()]
