"""Token id space, special tokens, and one code point for each token.

A token id is written as one character, so a segment is a plain string: ``replace`` merges a pair from left to right,
``substring`` lists neighbouring pairs, and string order is the order of pair keys.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TokenError

N_SPECIAL, BASE, MAX_VOCAB = 20, 276, 131_072
WHITESPACE = " \t\n\x0b\x0c\r"

#: Canonical bytes by id; id 19 is empty and reserved.
CANONICAL = (
    "<PAD>", "<UNK>", "<BOS>", "<EOS>", "<kareem_narration>", "<dylan_thinking>", "<DYLAN>", "<DYLAN_ADVERSARIAL>", "<BLU>", "<ECHO>",
    "<RESONANCE>", "<AI>", "<PHIL>", "<SYM>", "<REFLECTION>", "<CAIROS>", "[[/ANCHOR]]", "[[/CSA]]", "<science_doc>", "",
)
#: Spellings of each id.
ALIASES = {
    0: ("<PAD>",), 1: ("<UNK>",), 2: ("<BOS>",), 3: ("<EOS>",),
    4: ("<KAREEM>", "</KAREEM>", "<kareem_response>", "</kareem_response>", "<kareem_narration>", "</kareem_narration>"),
    5: ("<DYLAN_THINKING>", "</DYLAN_THINKING>", "<dylan_thinking>", "</dylan_thinking>"),
    6: ("<DYLAN_RESPONSE>", "</DYLAN_RESPONSE>", "<dylan_response>", "</dylan_response>", "<DYLAN>", "</DYLAN>"),
    7: ("<DYLAN_ADVERSARIAL>", "</DYLAN_ADVERSARIAL>"), 8: ("<BLU>", "</BLU>"), 9: ("<ECHO>", "</ECHO>"), 10: ("<RESONANCE>", "</RESONANCE>"),
    11: ("<AI>", "</AI>"), 12: ("<PHIL>", "</PHIL>"), 13: ("<SYM>", "</SYM>"), 14: ("<REFLECTION>", "</REFLECTION>"), 15: ("<CAIROS>", "</CAIROS>"),
    16: ("[[ANCHOR]]", "[[/ANCHOR]]"), 17: ("[[CSA]]", "[[/CSA]]"), 18: ("<science_doc>", "</science_doc>"),
}


@dataclass(frozen=True)
class SpecialTokens:
    canonical: tuple[str, ...] = CANONICAL
    aliases: tuple[tuple[str, int], ...] = tuple((a, i) for i, names in ALIASES.items() for a in names)

    @property
    def by_alias(self) -> dict[str, int]:
        return dict(self.aliases)

    def alternation(self) -> str:
        """Regex alternation of the aliases, longest first, for Java, RE2 and Python alike."""
        return "|".join(re.sub(r"([\[\]])", r"\\\1", a) for a in sorted(self.by_alias, key=lambda a: (-len(a), a)))

    def match_prefix(self, data: bytes) -> tuple[str, int] | None:
        """Longest alias that ``data`` begins with."""
        found = re.compile(self.alternation().encode("latin-1")).match(data)
        alias = found.group().decode("latin-1") if found else None
        return (alias, self.by_alias[alias]) if alias else None

    def is_sequence(self, line: bytes) -> bool:
        return bool(re.fullmatch(b"(?:" + self.alternation().encode("latin-1") + b")+", line))

    def vocabulary(self, spark):
        """Base vocabulary table (id, bytes, kind)."""
        rows = [(i, bytearray(t.encode("latin-1")), "special") for i, t in enumerate(self.canonical)]
        rows += [(N_SPECIAL + b, bytearray([b]), "byte") for b in range(256)]
        return spark.createDataFrame(rows, "id int, bytes binary, kind string")

    def alias_table(self, spark):
        return spark.createDataFrame(list(self.aliases), "alias string, id int")


SPECIAL = SpecialTokens()


def check_id(token: int) -> int:
    if not 0 <= token < MAX_VOCAB:
        raise TokenError("TokenIdOutOfRange", str(token))
    return token


def check_target(size: int) -> int:
    if not BASE <= size <= MAX_VOCAB:
        raise TokenError("VocabTargetOutOfRange", str(size))
    return size


def allocate(vocab_size: int) -> int:
    """Id of the next learned token."""
    if not BASE <= vocab_size < MAX_VOCAB:
        raise TokenError("VocabFull", str(vocab_size))
    return vocab_size


def byte_token(b: int) -> int:
    return N_SPECIAL + b


def pair_key(a: int, b: int) -> int:
    return check_id(a) << 32 | check_id(b)


def pair_key_column(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def symbol(token: int) -> str:
    return chr(token + 0x100 if token + 0x100 < 0xD800 else token + 0x900)


def token_of(char: str) -> int:
    return ord(char) - (0x100 if ord(char) < 0xD800 else 0x900)


def token_of_column(char: Column) -> Column:
    point = F.ascii(char)
    return F.when(point < 0xD800, point - 0x100).otherwise(point - 0x900).cast("int")


_LATIN = "".join(map(chr, range(256)))
_SYMBOLS = "".join(symbol(byte_token(b)) for b in range(256))


def to_symbols(latin: Column) -> Column:
    """Bytes as ISO-8859-1 text -> one base-token character each."""
    return F.translate(latin, _LATIN, _SYMBOLS)


def latin(data: Column) -> Column:
    """Bytes as text with one character each."""
    return F.decode(data.cast("binary"), "ISO-8859-1")


def valid_id(token: Column) -> Column:
    return token.between(0, MAX_VOCAB - 1)
