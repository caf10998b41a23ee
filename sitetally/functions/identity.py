"""Identities: rooms, lots, relations, labels, broken references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import BROKEN_REFERENCE_PREFIX, BROKEN_REFERENCES
from .text import blank_to_null, col, norm_token, strip


def short_sha1(c, length: int = 16) -> Column:
    return F.substring(F.sha1(col(c).cast("binary")), 1, length)


def _identity_hash(*parts) -> Column:
    return short_sha1(F.concat_ws("|", *[norm_token(p) for p in parts]))


def relation_key(room, material) -> Column:
    return F.concat(F.lit("v1:"), norm_token(room), F.lit("::"), norm_token(material))


def scope_id(niveau, occupation, numero) -> Column:
    return F.concat(F.lit("excel-scope-"), _identity_hash(niveau, occupation, numero))


def room_id(niveau, occupation, piece, numero) -> Column:
    return F.concat(F.lit("excel-room-"), _identity_hash(niveau, occupation, piece, numero))


def new_room_id(room) -> Column:
    return F.concat(F.lit("pdf-room-"), short_sha1(F.coalesce(F.nullif(norm_token(room), F.lit("")), F.lit("sans-nom"))))


def _with_level(label: Column, niveau) -> Column:
    return F.concat(label, F.coalesce(F.concat(F.lit(" ("), blank_to_null(niveau), F.lit(")")), F.lit("")))


def scope_label(niveau, occupation, numero) -> Column:
    return _with_level(
        F.concat_ws(
            " · ",
            F.coalesce(blank_to_null(occupation), F.lit("Pôle non renseigné")),
            F.concat(F.lit("lot n° "), blank_to_null(numero)),
        ),
        niveau,
    )


def room_label(niveau, occupation, piece, numero) -> Column:
    piece_part = F.when(F.coalesce(col(piece), F.lit("")) == "", F.lit("Pièce sans nom")).otherwise(strip(piece))
    return _with_level(
        F.concat_ws(" · ", blank_to_null(occupation), piece_part, F.concat(F.lit("n° "), blank_to_null(numero))),
        niveau,
    )


def is_broken_reference(material) -> Column:
    text = F.upper(strip(material))
    return text.startswith(BROKEN_REFERENCE_PREFIX) | text.isin(BROKEN_REFERENCES)


def is_usable_material(material) -> Column:
    return (strip(material) != "") & ~is_broken_reference(material)


def with_room_identity(listing):
    """Add the room and lot identity columns to listing rows."""
    parts = ("niveau", "occupation", "piece", "numero")
    return listing.withColumns({
        "room_id": room_id(*parts),
        "room_label": room_label(*parts),
        "scope_id": scope_id("niveau", "occupation", "numero"),
    })
