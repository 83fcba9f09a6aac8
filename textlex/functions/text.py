"""Column functions on text: normal forms, tokens, sentences, scripts and shapes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The White_Space characters, as a character class body for Java's and RE2's syntax.
WHITE_SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Letters with a diacritic and their plain letters.
MARKED, PLAIN = "îûşçê", "iusce"
SEPARATORS = rf"[\p{{P}}\p{{S}}{WHITE_SPACE}]+"
#: A run between separators that holds a letter, found in one pass.
WORD = rf"(?<![^\p{{P}}\p{{S}}{WHITE_SPACE}])[^\p{{P}}\p{{S}}\p{{L}}{WHITE_SPACE}]*+\p{{L}}[^\p{{P}}\p{{S}}{WHITE_SPACE}]*+"
SENTENCE = r"[^.!?…۔]*[.!?…۔]+|[^.!?…۔]+$"
SENTENCE_END = r"[.!?…۔]+"


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. Text below U+0300 is composed already and isn't sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def normalize(text: Column) -> Column:
    return F.lower(nfc(text))


def normalize_text(text: Column) -> Column:
    """Without control characters, U+200B and U+FEFF, then normalised."""
    return normalize(F.regexp_replace(text, r"[\p{Cc}\x{200B}\x{FEFF}]", ""))


def strip_diacritics(text: Column) -> Column:
    return F.translate(normalize(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Words in lower case: runs between punctuation, symbols and white space that hold a letter."""
    return words(normalize(text))


def words(normal: Column) -> Column:
    """Words of a text that is in normal form."""
    return F.regexp_extract_all(normal, F.lit(WORD), F.lit(0))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def sentences(text: Column) -> Column:
    """Pieces that end with a run of full stops and the like; those without a letter or number go."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), trim_space)
    return F.filter(pieces, lambda p: p.rlike(r"[\p{IsAlphabetic}\p{N}]"))


def document_key(text: Column) -> Column:
    """Form in which equal documents are the same: composed, line feeds only, lines and ends trimmed; null counts as empty."""
    lines = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, rf"(?m)[{WHITE_SPACE.replace(chr(92) + 'x{9}-' + chr(92) + 'x{D}', chr(92) + 'x{9}' + chr(92) + 'x{B}-' + chr(92) + 'x{D}')}]+$", ""), r"^\n+|\n+$", "")


def duplicate_group_id(text: Column) -> Column:
    return F.sha2(document_key(text), 256)


def sentence_key(text: Column) -> Column:
    return trim_space(F.regexp_replace(normalize(text), rf"[{WHITE_SPACE}]+", " "))


def token_class(token: Column) -> Column:
    return (
        F.when(token.rlike(r"://|^www\.|@.+\."), "url_or_email")
        .when(token.rlike(r"^[\p{N}.,]+$"), "numeric")
        .when(token.contains("�"), "replacement")
        .when(token.rlike(r"\p{Cc}"), "control")
        .when(token.rlike(r"[\p{IsArabic}\p{IsCyrillic}]"), "arabic_or_cyrillic")
        .otherwise("latin")
    )


def code_point(char: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(char))


def graphemes(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))).cast("long")


def script_class(word: Column) -> Column:
    """By the scripts of the letters; of other scripts the name isn't told."""
    letters = F.regexp_replace(word, r"[^\p{L}]|[\p{IsCommon}\p{IsInherited}]", "")
    latin, arabic, cyrillic = (letters.rlike(rf"\p{{Is{s}}}") for s in ("Latin", "Arabic", "Cyrillic"))
    other = letters.rlike(r"[^\p{IsLatin}\p{IsArabic}\p{IsCyrillic}]")
    return (
        F.when(letters == "", "NO_SCRIPTED_LETTERS")
        .when(latin & ~arabic & ~cyrillic & ~other, "LATIN_ONLY")
        .when(arabic & ~latin & ~cyrillic & ~other, "ARABIC_ONLY")
        .when(cyrillic & ~latin & ~arabic & ~other, "CYRILLIC_ONLY")
        .when(latin & arabic & ~cyrillic & ~other, "LATIN_ARABIC_MIXED")
        .when(latin & cyrillic & ~arabic & ~other, "LATIN_CYRILLIC_MIXED")
        .when(other & ~latin & ~arabic & ~cyrillic & _one_script(letters), F.concat(F.lit("OTHER_SINGLE_SCRIPT:"), _script_name(letters)))
        .otherwise("OTHER_MIXED_SCRIPT")
    )


#: Names of scripts that are told apart beside Latin, Arabic and Cyrillic.
SCRIPTS = (
    "Greek Armenian Hebrew Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala "
    "Thai Lao Tibetan Myanmar Georgian Hangul Ethiopic Cherokee Khmer Mongolian Hiragana Katakana Han Bopomofo Yi Gothic Coptic"
).split()


def _one_script(letters: Column) -> Column:
    found = F.lit(False)
    for s in SCRIPTS:
        found = found | letters.rlike(rf"^\p{{Is{s}}}+$")
    return found


def _script_name(letters: Column) -> Column:
    name = F.lit("Unknown")
    for s in SCRIPTS:
        name = F.when(letters.rlike(rf"^\p{{Is{s}}}+$"), s).otherwise(name)
    return name


def shape(word: Column, normalized: Column) -> dict[str, Column]:
    """Flags and lengths of an entry, by name."""
    solid = F.regexp_replace(normalized, rf"[{WHITE_SPACE}]+", "")
    letters = F.regexp_replace(word, r"[^\p{L}]+", "")
    upper, lower = word.rlike(r"\p{IsUppercase}"), word.rlike(r"\p{IsLowercase}")
    punctuation, symbol, digit = (solid.rlike(rf"^\p{{{c}}}+$") for c in "PSN")
    title = letters.rlike(r"^\p{IsUppercase}\p{IsLowercase}+$")
    n = graphemes(normalized)
    return {
        "punctuation_only": punctuation,
        "symbol_only": symbol & ~punctuation,
        "digit_only": digit & ~punctuation & ~symbol,
        "no_letters": ~solid.rlike(r"\p{L}"),
        "uppercase_only": upper & ~lower,
        "title_case": title,
        "mixed_case": upper & lower & ~title,
        "contains_digits": solid.rlike(r"\p{N}") & solid.rlike(r"\p{L}"),
        "contains_hyphen": normalized.contains("-"),
        "contains_apostrophe": normalized.rlike("['’]"),
        "multiword": normalized.contains(" "),
        "very_short": n <= 1,
        "very_long_25": n > 25,
        "very_long_40": n > 40,
        "scalar_length": F.char_length(normalized).cast("long"),
        "grapheme_length": n,
    }


def proper_noun(word: Column) -> Column:
    return F.regexp_replace(word, r"[^\p{L}]+", "").rlike(r"^\p{IsUppercase}\p{IsLowercase}+$")


def raw_line_flags(line: Column) -> dict[str, Column]:
    return {
        "leading_space": line.rlike(rf"^[{WHITE_SPACE}]"),
        "trailing_space": line.rlike(rf"[{WHITE_SPACE}]\z"),
        "tab": line.contains("\t"),
        "control": line.rlike(r"[\p{Cc}&&[^\t\n\r\x{0}]]"),
        "carriage_return": line.contains("\r"),
        "null_byte": line.contains("\0"),
        "replacement": line.contains("�"),
    }


@F.pandas_udf(StringType())
def general_category(char: pd.Series) -> pd.Series:
    """Two-letter general category of a character; meant for distinct characters."""
    return char.map(lambda c: unicodedata.category(c) if c else None)


def map_part_of_speech(morphology: Column) -> Column:
    tag = F.substring(F.get(F.filter(morphology, lambda m: m.startswith("po:")), 0), 4, 1000)
    out = F.coalesce(tag, F.lit("unknown"))
    #: Tags of each part of speech.
    for name, tags in {
        "adjective": ["adj", "adjective"],
        "noun": ["noun", "n"],
        "verb": ["verb", "v"],
        "adverb": ["adv", "adverb"],
        "interjection": ["ij", "interj", "interjection"],
        "preposition": ["prep", "preposition"],
        "conjunction": ["conj", "conjunction"],
        "pronoun": ["pron", "pronoun"],
    }.items():
        out = F.when(F.lower(tag).isin(tags), name).otherwise(out)
    return out
