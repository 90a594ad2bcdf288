"""Classification of incidents and sales as ordered column expressions, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col

# Incident categories with label and weight, and the patterns that tell them.
CATEGORIES = {
    "homicide": ("Homicide", 10.0, r"\bHOMICIDES?\b|\bMURDERS?\b|\bMANSLAUGHTER\b"),
    "rape_sexual_assault": ("Rape / Sexual Assault", 9.0, r"\bRAPES?\b|SEXUAL ASSAULT|SEXUAL ABUSE|\bSODOMY\b|CRIM(?:INAL)?\s*SEXUAL"),
    "kidnapping_trafficking": ("Kidnapping / Trafficking", 8.5, r"\bKIDNAP|\bABDUCT|HUMAN TRAFFICKING|\bTRAFFICKING\b"),
    "robbery": ("Robbery", 7.5, r"\bROBBERY\b|\bROBBED\b|CARJACK"),
    "aggravated_assault": ("Aggravated Assault", 7.0, r"AGGRAVAT\w*\s*ASSAULT|\bAGG\.?\s*ASSAULT|ASSAULT[^.]{0,25}(?:FIREARM|WEAPON|DEADLY|GUN|KNIFE)|\bSHOOTING\b|SHOTS FIRED|\bSTABBING\b|DISCHARGE[^.]{0,15}FIREARM|RECKLESS\w*\s*ENDANGER"),
    "arson": ("Arson", 6.0, r"\bARSON\b"),
    "burglary": ("Burglary", 5.0, r"\bBURGLAR|BREAKING\s*(?:AND|&)\s*ENTERING|\bB\s?&\s?E\b"),
    "weapons": ("Weapons Violation", 5.0, r"WEAPONS?\s*(?:VIOLATION|OFFEN[CS]E)|ILLEGAL[^.]{0,15}(?:FIREARM|GUN)|CARRYING[^.]{0,20}CONCEALED|PROHIBITED\s*(?:WEAPON|FIREARM)|FELON[^.]{0,15}(?:FIREARM|WEAPON)"),
    "sex_offense_other": ("Other Sex Offense", 4.5, r"INDECENT EXPOSURE|PUBLIC INDECENCY|\bPROSTITUTION\b|\bLEWDNESS\b|\bOBSCENITY\b"),
    "motor_vehicle_theft": ("Motor Vehicle Theft", 4.0, r"MOTOR\s*VEH(?:ICLE)?\s*THEFT|MTR\s*VEH(?:ICLE)?\s*THEFT|\bAUTO\s*THEFT\b|\bUUV\b|UNAUTHORIZED USE[^.]{0,15}VEHICLE|STOLEN\s*(?:AUTO|VEHICLE|CAR)\b"),
    "simple_assault": ("Simple Assault / Battery", 3.5, r"\bASSAULT\b|\bBATTERY\b"),
    "drug_offense": ("Drug / Narcotics", 3.0, r"NARCOTIC|\bDRUG\b|CONTROLLED SUBSTANCE|POSSESS\w*[^.]{0,20}(?:COCAINE|HEROIN|MARIJUANA|METH|FENTANYL|NARCOTIC)"),
    "theft_larceny": ("Theft / Larceny", 2.5, r"\bTHEFTS?\b|\bLARCEN(?:Y|IES)\b|SHOPLIFT|STOLEN PROPERTY|\bPICKPOCKET"),
    "threats_harassment": ("Threats / Harassment / Stalking", 2.25, r"HAR{1,2}ASSMENT|\bTHREAT|\bSTALKING\b|\bINTIMIDATION\b"),
    "fraud_forgery": ("Fraud / Forgery / Embezzlement", 2.0, r"\bFRAUD\b|\bFORGERY\b|EMBEZZLEMENT|COUNTERFEIT|IDENTITY THEFTS?|BAD CHECKS?|DECEPTIVE PRACTICE"),
    "vandalism": ("Vandalism / Criminal Mischief", 1.5, r"VANDALISM|CRIMINAL (?:MISCHIEF|DAMAGE)|\bGRAFFITI\b"),
    "dui": ("DUI / Impaired Driving", 1.5, r"\bDUI\b|\bDWI\b|\bOVI\b|DRIVING UNDER[^.]{0,10}INFLUENCE|OPERATING[^.]{0,10}INFLUENCE"),
    "disorderly_quality_of_life": ("Disorderly Conduct / Quality of Life", 1.0, r"DISORDERLY|PUBLIC DRUNK|INTOXICAT|\bLOITERING\b|\bTRESPASS|\bCURFEW\b|\bNUISANCE\b|\bVAGRANCY\b|\bPROWLER\b|NOISE (?:COMPLAINT|VIOLATION)"),
    "other": ("Other / Unclassified", 1.0, None),
}

# Sale codes and words of sales that are not at market value, with the reason.
NOT_AT_MARKET = {
    "3": "Love and affection / nominal consideration",
    "5": "Quit-claim deed",
    "6": "Foreclosure / sheriff's sale",
    "11": "Related party transfer",
    "16": "Government / tax sale",
    "99": "Corrective deed or duplicate sale",
    "CO": "Corrective instrument",
    "H": "Multi-parcel sale",
    "LOVE AND AFFECTION": "Love and affection / nominal consideration",
    "CORRECTIVE": "Corrective deed",
    "ESTATE": "Estate sale",
    "FORECLOSURE": "Foreclosure",
    "SHERIFF": "Sheriff's sale",
}
ESTATE_CODE, ESTATE_FLAG, NOMINAL_FLAG = "37", "Estate sale — may be below market", "Nominal price ($1 or $0)"


def heaviest(text, categories: dict[str, tuple[str, float, str | None]] = CATEGORIES, fallback: str = "other") -> Column:
    """struct(key, label, weight) of the heaviest category that matches; the earlier one of equals."""
    upper = F.upper(F.coalesce(col(text).cast("string"), F.lit("")))
    ranked = sorted(((k, v) for k, v in categories.items() if v[2]), key=lambda x: -x[1][1])  # stable: earlier first
    named = lambda k: F.struct(F.lit(k).alias("key"), F.lit(categories[k][0]).alias("label"), F.lit(categories[k][1]).alias("weight"))
    chain = F.when(F.trim(upper).isin("", "NAN", "NONE", "NULL"), named(fallback))
    for key, (_, _, pattern) in ranked:
        chain = chain.when(upper.rlike(pattern), named(key))
    return chain.otherwise(named(fallback))


def classified(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``heaviest`` of a column: each different text is classified once, and there are far fewer than rows."""
    known = df.select(F.col(text).alias("_text")).distinct().withColumn(name, heaviest("_text"))
    return df.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def at_market(code, description, instrument, price) -> Column:
    """struct(is_arms_length, flag) of a sale."""
    code, description, instrument = (F.upper(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))) for c in (code, description, instrument))
    told = lambda ok, why: F.struct(F.lit(ok).alias("is_arms_length"), F.lit(why).alias("flag"))
    chain = F.when(F.coalesce(col(price), F.lit(0.0)) <= 1, told(False, NOMINAL_FLAG))
    for of in (code, instrument):
        for key, why in NOT_AT_MARKET.items():
            chain = chain.when(of == key, told(False, why))
    for key, why in NOT_AT_MARKET.items():
        if len(key) > 2:
            chain = chain.when(description.contains(key), told(False, why))
    return chain.when((code == ESTATE_CODE) | description.contains("ESTATE"), told(True, ESTATE_FLAG)).otherwise(told(True, ""))
