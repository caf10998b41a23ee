"""Literal frames shared by the tests."""

from sitetally.functions.identity import with_room_identity
from sitetally.plans.comparison import TABLES, Comparison

LISTING = ("job_id BIGINT, sheet_idx INT, row_idx BIGINT, niveau STRING, occupation STRING, piece STRING, numero STRING, "
           "categorie STRING, code_article STRING, materiel STRING, quantite BIGINT")
SYMBOLS = ("job_id BIGINT, seq BIGINT, page INT, page_type STRING, label STRING, article STRING, categorie STRING, x DOUBLE, "
           "y DOUBLE, room STRING, room_dist DOUBLE, source STRING, detection_id STRING, confidence DOUBLE, "
           "original_article STRING, original_reference STRING")
MANUAL = ("job_id BIGINT, seq BIGINT, id STRING, mapping_key STRING, room STRING, material STRING, category STRING, label STRING, "
          "quantity_after STRING, target_room_id STRING, target_material STRING, is_addition BOOLEAN")


def listing(spark, *rows, job=1):
    """rows: (occupation, piece, numero, materiel, quantite[, categorie[, niveau]])"""
    full = []
    for i, row in enumerate(rows):
        occupation, piece, numero, materiel, quantite, *rest = row
        categorie = rest[0] if rest else "Électricité"
        niveau = rest[1] if len(rest) > 1 else "R+2"
        full.append((job, 0, i, niveau, occupation, piece, numero, categorie, "", materiel, quantite))
    return with_room_identity(spark.createDataFrame(full, LISTING))


def symbols(spark, *rows, job=1):
    """rows: (room, article[, label])"""
    full = [
        (job, i, 5, "ELECTRICITE", r[2] if len(r) > 2 else r[1], r[1], "Électricité", 10.0, 10.0, r[0], 0.0, "texte", "", 0.0, "", "")
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, SYMBOLS)


def table(spark, name, *rows):
    return spark.createDataFrame(list(rows), TABLES[name])


def manual(spark, *rows):
    return spark.createDataFrame(list(rows), MANUAL)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def compare(listing_df, symbols_df, **kw):
    return Comparison(listing_df, symbols_df, **kw)
