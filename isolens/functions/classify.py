"""Free-text classification by ordered rules.  Rules are data and can be replaced by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markers import first_match
from .text import clean_text, col, squish

# Words that mark a poultry source, and spellings read as "chicken".
POULTRY_PATTERN = (
    r"\bchicken\b|\bchick\b|\bpoultry\b|\bhen\b|\bbroiler\b|\blayer\b|\bgallus\b|gallus\s+gallus|"
    r"\begg\b|\beggs\b|\begg\s*product\b|\bproduct\s*eggs\b|\begg\s*yolk(s)?\b|\byolk(s)?\b|"
    r"\bhatchery\b|\bhatching\b|\bhatcher(y)?\b|\bbox\s*liner(s)?\b|\bliner(s)?\b|\bdrag\s*swab(s)?\b"
)
MISSPELT_CHICKEN = r"\bchicekn\b|\bchikcen\b|\bchcken\b"
GLUED_CHICKEN = r"chicken(?=[a-z])"
# Origin patterns.
USA_PATTERN = r"(\busa\b|\bunited\s*states\b|\bu\s*\.\s*s\s*\.\b|\bus\b)"
ID_PATTERN = r"(\bcfsan\b|\bfda\b)"
# Animal vocabulary, first match wins.
ANIMAL_RULES = (
    (r"\b(chicken|broiler|hen)\b", "Chicken"),
    (r"\bturkey\b", "Turkey"),
    (r"\b(cattle|bovine|beef|steer|calf|veal|bos taurus)\b", "Cattle"),
    (r"\b(sheep|lamb|ovine|goat|caprine)\b", "Sheep/goat"),
    (r"\b(swine|sow|pork|porcine)\b", "Swine"),
)
# Commodity vocabulary (pattern, excluded pattern, label), first match wins.
COMMODITY_RULES = (
    (r"rabbit", None, "Rabbit meat/products"),
    (r"\b(shrimp|crab|lobster)\b", r"imitation\s+crab", "Crustaceans"),
    (r"\b(squid|cuttlefish|snail|mussel|clam)\b", None, "Mollusks"),
    (r"imitation\s+crab", None, "Processed/imitated seafood"),
    (r"\b(fish|tilapia|catfish|pompano|pomfret|pangasius|scad|esomus)\b", None, "Finfish"),
    (r"\b(guinea\s+pig|quail)\b", None, "Other terrestrial animals"),
    (r"\b(cake|biscuit|cookie|cookies|marshmallow|snack\s+bar)\b", None, "Bakery/confectionery"),
    (r"\b(cheese|morbier)\b", None, "Dairy/cheese"),
    (r"\bdog\s+chew\b", None, "Pet chew (meat unspecified)"),
    (r"\b(pepper|chili|fenugreek|thyme|spice|spiced|almond|dandelion|cilantro|melon\s+seed|coriander|kava)\b", None,
     "Plants/herbs/spices/nuts/seeds"),
)
# Variant effects of high and of moderate impact.
HIGH_IMPACT = (
    "frameshift_variant", "stop_gained", "stop_lost", "start_lost", "splice_acceptor_variant",
    "splice_donor_variant", "exon_loss_variant", "feature_ablation", "transcript_ablation",
)
MODERATE_IMPACT = ("missense_variant", "protein_altering_variant", "inframe_insertion", "inframe_deletion")


def normalize_source_words(c: Column | str) -> Column:
    """Letters only, glued "chicken" words cut apart, known misspellings repaired."""
    x = F.regexp_replace(F.lower(clean_text(c)), r"[^a-z]+", " ")
    x = F.regexp_replace(x, GLUED_CHICKEN, "chicken ")
    x = F.regexp_replace(x, MISSPELT_CHICKEN, "chicken")
    return squish(x)


def classify_source(source_type, isolation_source, host, category, collected_by) -> Column:
    """Primary source: Human by type, Chicken by vocabulary, then overrides for the rest."""
    def low(c):
        return F.lower(clean_text(c))

    return (
        F.when(low(source_type).rlike(r"\bhuman\b"), F.lit("Human"))
        .when(normalize_source_words(isolation_source).rlike(POULTRY_PATTERN), F.lit("Chicken"))
        .when(low(host).contains("chicken") | low(category).contains("chicken"), F.lit("Chicken"))
        .when(low(collected_by).contains("cdc"), F.lit("Human"))
        .otherwise(F.lit("Other"))
    )


def derive_origin(source, strain, identifiers, food_origin) -> dict[str, Column]:
    """Origin (US / Non-US), source group, and the final source with foreign groups collapsed."""
    def low(c):
        return F.lower(clean_text(c))

    agency = low(strain).startswith("fda") | low(identifiers).rlike(ID_PATTERN)
    food = low(food_origin)
    origin = F.when(agency & (food != "") & ~food.rlike(USA_PATTERN), F.lit("Non-US")).otherwise(F.lit("US"))
    src = col(source)
    group = F.when(F.lower(src) == "human", F.lit("Human")).otherwise(F.concat_ws("-", src, origin))
    final = F.when(group.isin("Chicken-Non-US", "Other-Non-US"), F.lit("International")).otherwise(group)
    return {"origin_group": origin, "source_group": group, "final_source": final}


def classify_animal(c: Column | str, rules=ANIMAL_RULES, default: str = "Others") -> Column:
    return first_match(F.lower(clean_text(c)), rules, default)


def classify_commodity(
    isolation,
    source_group,
    rules=COMMODITY_RULES,
    poultry_group: str = "Chicken-Non-US",
    poultry_label: str = "Chicken-containing pet treats",
    default: str = "Unclassified — review literal source",
) -> Column:
    x = F.lower(F.trim(F.coalesce(col(isolation), F.lit(""))))
    expr = F.when(col(source_group) == poultry_group, F.lit(poultry_label))
    for pattern, unless, label in rules:
        cond = x.rlike(pattern)
        if unless:
            cond = cond & ~x.rlike(unless)
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def impact_class(effects: Column | str, high=HIGH_IMPACT, moderate=MODERATE_IMPACT, sep: str = ";") -> Column:
    """Highest impact over a packed list of effects."""
    parts = F.transform(F.split(F.coalesce(col(effects), F.lit("")), sep), lambda x: F.trim(x))
    return (
        F.when(F.arrays_overlap(parts, F.array(*[F.lit(h) for h in high])), F.lit("High"))
        .when(F.arrays_overlap(parts, F.array(*[F.lit(m) for m in moderate])), F.lit("Moderate"))
        .otherwise(F.lit("Low"))
    )
