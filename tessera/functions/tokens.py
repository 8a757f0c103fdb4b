"""Tokenizer plug point.

The subword vocabulary the training data was counted with is an external
download, so the default tokenizer here is whitespace words (a stated
divergence).  Any Column -> ARRAY<STRING> function can be passed instead
wherever an operator takes ``tokenizer=``.

Token ids come from a vocabulary-free hash so the long token tables carry
integers: the first 8 hex digits of md5(token) modulo the text vocabulary
size.  Chat control tokens keep their fixed ids.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

# Fixed values of the chat vocabulary (must equal the reference's ids).
TEXT_VOCAB = 151643
PAD_ID = 151643          # <|endoftext|>
IM_START_ID = 151644     # <|im_start|>
IM_END_ID = 151645       # <|im_end|>
VISION_START_ID = 151652
VISION_END_ID = 151653
IMAGE_PAD_ID = 151655
VIDEO_PAD_ID = 151656
NEWLINE_ID = 198         # "\n"
IGNORE_INDEX = -100

Tokenizer = Callable[[Column], Column]


def whitespace_tokenizer(col: Column) -> Column:
    return words(col)


def token_id(tok: Column) -> Column:
    """Hash id of one text token, in [0, TEXT_VOCAB)."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(TEXT_VOCAB))


def token_ids(tokens: Column) -> Column:
    return F.transform(tokens, token_id)
