"""Text helpers of the reference's reports and feeds as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count in titles.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "for", "of", "to", "in", "on", "with", "by", "from", "at", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "shall", "can", "need", "dare", "ought", "used", "this", "that", "these", "those", "phase", "ii", "iii", "i", "sbir", "sttr", "development", "system", "systems", "technology", "advanced", "based", "using",
    "new", "novel", "improved",
)
# Groups of terms that stand for each other.
TERM_GROUPS = (
    ("uas", "uav", "unmanned aerial", "drone", "rpas", "remotely piloted"),
    ("counter-uas", "c-uas", "counter-drone", "anti-drone", "drone defense", "cuas"),
    ("ew", "electronic warfare", "electronic countermeasures", "ecm", "electronic attack"),
    ("directed energy", "directed_energy", "laser weapon", "high-energy laser", "hel", "dew"),
    ("satcom", "satellite communications", "satellite comms"),
    ("pnt", "positioning navigation timing", "alternative pnt", "gps-denied navigation"),
    ("isr", "intelligence surveillance reconnaissance"),
    ("jadc2", "joint all-domain", "joint all domain command"),
    ("sda", "space domain awareness", "space situational awareness", "ssa"),
    ("c2", "command control", "command and control", "battle management"),
    ("ai", "artificial intelligence", "machine learning", "ml", "ai_ml"),
    ("sigint", "signals intelligence"),
    ("lidar", "light detection ranging", "laser radar"),
    ("mesh networking", "mesh network", "tactical network", "mobile ad-hoc"),
    ("anti-jam", "jam-resistant", "anti-jamming", "jam resistant"),
    ("autonomous navigation", "autonomous nav", "gps-denied", "gps denied"),
    ("swarm", "swarm defeat", "counter-swarm", "massed attack"),
    ("undersea warfare", "undersea", "submarine", "asw", "anti-submarine"),
    ("mine warfare", "mine countermeasures", "mcm", "demining"),
    ("target recognition", "target identification", "automatic target", "atr"),
    ("kill chain", "kill-chain", "sensor-to-shooter", "sensor to shooter"),
    ("additive manufacturing", "3d printing", "3-d printing", "am manufacturing"),
    ("microelectronics", "microchip", "semiconductor", "trusted foundry"),
    ("munitions", "munitions production", "ammunition", "ordnance"),
    ("hypersonic", "hypersonics", "hypersonic weapon", "scramjet"),
    ("cyber", "cybersecurity", "cyber security", "cyber warfare"),
    ("quantum", "quantum computing", "quantum sensing", "quantum communications"),
    ("counter-space", "counterspace", "space protection", "satellite protection"),
    ("autonomous resupply", "autonomous logistics", "unmanned logistics", "unmanned resupply"),
    ("fire coordination", "fire control", "fires coordination", "coordinated fires"),
)
#: Each term with the others of its group.
SYNONYMS = {t: tuple(o for o in g if o != t) for g in TERM_GROUPS for t in g}
# The words in a text that give it a technology tag.
TAG_WORDS = {
    "ai_ml": ("artificial intelligence", "machine learning", "deep learning", "neural network", "computer vision", "natural language processing", "nlp", "reinforcement learning", "predictive analytics", "cognitive", "autonomous decision", "agentic", " ai ", "llm", "large language model", "generative ai"),
    "autonomy": ("autonomous", "unmanned", "uav", "ugv", "usv", "uuv", "drone", "robotics", "robot", "self-driving", "automated", "swarm", "uas ", "suas", "counter-uas"),
    "cyber": ("cyber", "cybersecurity", "encryption", "cryptograph", "malware", "intrusion", "network security", "zero trust", "penetration", "vulnerability", "secure "),
    "space": ("satellite", "spacecraft", "orbital", "space-based", "launch vehicle", "propulsion", "cislunar", "leo ", " geo ", "small sat", "cubesat", "space application", "in-space", "on-orbit"),
    "quantum": ("quantum", "qubit", "quantum computing", "quantum sensing", "quantum communication", "quantum cryptography", "post-quantum"),
    "hypersonics": ("hypersonic", "scramjet", "mach 5", "high-speed", "thermal protection", "hypersonic glide", "boost-glide", "reentry"),
    "biotech": ("biotech", "biotechnology", "synthetic biology", "gene", "crispr", "biologic", "pharmaceutical", "vaccine", "therapeutic", "biomaterial", "biodefense", "medical", "health", "tissue"),
    "sensors": ("sensor", "radar", "lidar", "sonar", "electro-optical", "infrared", "rf sensing", "imaging", "detection", "surveillance", "reconnaissance", "isr", "spectrometer", "optical", "camera", "night vision", "thermal", "multispectral", "hyperspectral"),
    "communications": ("5g", "6g", "communications", "datalink", "mesh network", "satcom", "software defined radio", "sdr", "tactical network", "resilient comms", "antenna", "waveform", "radio", "wireless"),
    "directed_energy": ("directed energy", "laser", "high-energy laser", "hel", "microwave", "high-powered microwave", "hpm", "particle beam", "beam control"),
    "materials": ("metamaterial", "composite", "advanced material", "lightweight", "armor", "ceramic", "carbon fiber", "additive manufacturing", "3d printing", "additive", "coating", "alloy", "thermal", "insulation"),
    "electronics": ("semiconductor", "microelectronics", "photonics", "fpga", "asic", "power electronics", "gan", "sic", "silicon carbide", "circuit", "chip"),
    "c4isr": ("c4isr", "command and control", "battle management", "situational awareness", "targeting", "kill chain", "decision support", "mission planning"),
    "ew": ("electronic warfare", " ew ", "jamming", "spoofing", "sigint", "elint", "spectrum", "counter-uas", "c-uas", "countermeasure"),
    "simulation": ("simulation", "modeling", "synthetic", "digital twin", "virtual", "training", "lvc ", "live virtual"),
    "manufacturing": ("manufacturing", "production", "machining", "casting", "forging", "assembly", "supply chain", "logistics"),
}
# Names of agencies and what they are listed under; the first that a name contains counts.
AGENCY_NAMES = {
    "dept of the air force": "Air Force", "department of the air force": "Air Force", "air force": "Air Force", "dept of the army": "Army", "department of the army": "Army", "army": "Army",
    "dept of the navy": "Navy", "department of the navy": "Navy", "navy": "Navy", "defense advanced research projects agency": "DARPA", "darpa": "DARPA", "missile defense agency": "MDA", "mda": "MDA",
    "defense logistics agency": "DLA", "dla": "DLA", "defense threat reduction agency": "DTRA", "dtra": "DTRA", "national geospatial-intelligence agency": "NGA", "nga": "NGA", "national security agency": "NSA", "nsa": "NSA",
    "special operations command": "SOCOM", "us special operations command": "SOCOM", "socom": "SOCOM", "space force": "Space Force", "united states space force": "Space Force", "office of the secretary of defense": "OSD", "osd": "OSD",
    "defense information systems agency": "DISA", "disa": "DISA", "defense intelligence agency": "DIA", "dia": "DIA", "department of homeland security": "DHS", "dhs": "DHS", "customs and border protection": "CBP", "cbp": "CBP",
    "national aeronautics and space administration": "NASA", "nasa": "NASA", "department of energy": "DOE", "doe": "DOE",
}
# Endings of names in capital letters as they should be written, then the parts of a name.
NAME_ENDINGS = ((" Inc", " Inc."), (" Llc", " LLC"), (" Corp", " Corp."), (" Ltd", " Ltd."), (" Lp", " LP"), (" Pllc", " PLLC"), (",Inc.", ", Inc."), (", Inc", ", Inc."), (",Llc", ", LLC"), (", Llc", ", LLC"))
NAME_PARTS = (
    ("Ai ", "AI "), ("Rf ", "RF "), ("Uas ", "UAS "), ("Uav ", "UAV "), ("Ew ", "EW "), ("Isr ", "ISR "), ("Gps ", "GPS "), ("Pnt ", "PNT "), (" Ii ", " II "), (" Iii ", " III "), (" Iv ", " IV "), ("Usa ", "USA "), ("Us ", "US "),
    (" Llc", " LLC"), ("Dba ", "DBA "), ("Dod ", "DoD "), (" Ar ", " AR "), ("Hq ", "HQ "), (" De ", " de "), (" Of ", " of "), (" And ", " and "), (" The ", " the "), (" For ", " for "),
)
# What makes the name of an investor that of a firm.
FIRM_WORDS = ("capital", "ventures", "partners", "fund", "holdings", "equity", "investments")


def clean_title(c: Column) -> Column:
    """A title without the question marks, control and replacement characters that it begins with."""
    return F.regexp_replace(c, r"^[?\s\p{Cntrl}�]+", "")


def title_words(c: Column) -> Column:
    """The words of a title from the third letter on that count, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z][a-z-]+)")), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def title_terms(c: Column) -> Column:
    """The distinct words, upper-case abbreviations and pairs of neighbouring words of a title, sorted."""
    words = title_words(c)
    short = F.transform(F.regexp_extract_all(c, F.lit(r"\b([A-Z][A-Z0-9-]{1,8})\b")), lambda w: F.lower(w))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(words, short, pairs)))


def tag_terms(tag: Column) -> Column:
    """A tag, its form with blanks, and its single words, sorted."""
    t = F.lower(F.trim(tag))
    return F.array_sort(F.array_distinct(F.concat(F.array(t, F.replace(t, F.lit("_"), F.lit(" "))), F.split(F.regexp_replace(t, "[_-]", " "), " "))))


def with_synonyms(terms: Column) -> Column:
    """Terms with the other names of those that have some, and the words of these."""
    known = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    more = F.flatten(F.transform(F.filter(terms, lambda t: t.isin(*SYNONYMS)), lambda t: known[t]))
    return F.array_sort(F.array_distinct(F.concat(terms, more, F.flatten(F.transform(more, lambda s: F.split(s, " "))))))


def investor_name(c: Column) -> Column:
    """An investor's name without the legal form at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i),?\s*(LLC|L\.L\.C\.|LP|L\.P\.|Inc\.?|Corp\.?)$", ""), r"\s+", " "))


def is_firm(c: Column) -> Column:
    """Whether an investor's name looks like that of a firm: a telling word, a legal form, or three words."""
    t = F.lower(c)
    return t.rlike("|".join(FIRM_WORDS)) | t.rlike(r"\b(inc|llc|lp|corp|ltd)\b") | (F.size(F.split(F.trim(c), r"\s+")) >= 3)


def stage_of_total(v: Column) -> Column:
    """A stage estimated from a total value."""
    return F.when(v > 100_000_000, "production").when(v > 20_000_000, "growth").when(v > 5_000_000, "expansion").when(v > 1_000_000, "early").otherwise("seed")


def safe_log(v: Column) -> Column:
    """log10(v + 1), and 0 for nothing and less."""
    return F.when(v > 0, F.log10(v + 1)).otherwise(0.0)


def unfenced(c: Column) -> Column:
    """The JSON out of a text that may hold it in a fence of three backticks."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(c))


def keyword_tags(c: Column) -> Column:
    """The technology tags that a text speaks of, sorted; an empty list for none and for null."""
    t = F.lower(c)
    return F.array_compact(F.array(*[F.when(t.rlike("|".join(TAG_WORDS[k])), F.lit(k)) for k in sorted(TAG_WORDS)]))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small others."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def display_name(c: Column) -> Column:
    """A name in capital letters as it should be written: title case, legal forms and abbreviations put right."""
    t = title_case(F.trim(c))
    for wrong, right in NAME_ENDINGS:
        t = F.regexp_replace(t, re.escape(wrong) + r"\z", right)
    for wrong, right in NAME_PARTS:
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return t


def agency_name(c: Column) -> Column:
    """An agency as listed: by its whole name, else by the first listed name in it, else in title case; Unknown if null or empty."""
    t = F.lower(F.trim(c))
    out = title_case(F.trim(c))
    for name, short in reversed(AGENCY_NAMES.items()):
        out = F.when(t.contains(name), F.lit(short)).otherwise(out)
    known = F.create_map(*[F.lit(x) for pair in AGENCY_NAMES.items() for x in pair])
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(F.coalesce(known[t], out))
