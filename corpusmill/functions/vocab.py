"""Vocabularies and patterns of the hafnia profile. Everything here is a parameter of the operators."""

from __future__ import annotations

# Keyword lists of the profile (substring tests on lower-case text padded with blanks).
HFO2_KEYWORDS = ["hfo2", "hzo", "hfzro", "hf0.5zr0.5o2", "hf1-xzrxo2", "hafnia", "hafnium oxide", "ferroelectric"]
PROPERTY_KEYWORDS = ["2pr", "2.pr", " pr ", "remanent", "polarization", "ec", "coercive", "endurance", "retention", "wake-up", "fatigue", "leakage", "memory window", "switching", "breakdown", "dielectric constant", "pund"]
PROCESS_KEYWORDS = ["ald", "atomic layer deposition", "sputter", "sputtering", "pld", "mocvd", "sol-gel", "anneal", "annealing", "rta", "pma", "pda", "tin", "electrode", "substrate", "thickness", "nm", "orthorhombic", "pca21", "tetragonal", "monoclinic", "xrd"]
DOMAIN_KEYWORDS = ["hfo2", "hafnium oxide", "hafnia", "hzo", "hfzro", "hfxzr", "ferroelectric", "orthorhombic", "pca21", "fefet", "pr", "2pr", "coercive", "remanent"]
DOMAIN_MATERIALS = ["hfo2", "hafnium oxide", "hafnia", "hzo", "hfzro"]
FORMULA = r"(?i)Hf[\w.\-\s]*O\s*2|Hf0\.?5Zr0\.?5O2"

# Section names by words in the first 160 characters, in order of precedence.
SECTIONS = [("abstract", ["abstract"]), ("introduction", ["introduction"]), ("method", ["method", "experimental"]), ("results", ["result", "discussion"]), ("conclusion", ["conclusion", "summary"]), ("references", ["references"])]

# Identifiers and years.
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
YEAR = r"\b(20[12]\d)\b"
FILE_YEAR = r"^(20[12]\d)[_\-\s]"
REVIEW_HINT = r"(?i)\b(review|progress|perspective|status|prospects|bulletin|comprehensive)\b"
COMPUTATIONAL = r"(?i)\b(first[-\s]?principles|DFT|phase[-\s]?field|simulation|model)\b"
THEORETICAL = r"(?i)\b(theoretical|theory)\b"

# Unit spellings and their canonical unit, by reduced spelling.
UNIT_ALIASES = {"uc/cm2": "μC/cm²", "μc/cm2": "μC/cm²", "μc/cm²": "μC/cm²", "uc cm-2": "μC/cm²", "μc cm−2": "μC/cm²", "mv/cm": "MV/cm", "mv cm-1": "MV/cm", "mv cm−1": "MV/cm", "kv/cm": "MV/cm", "a/cm2": "A/cm²", "a/cm²": "A/cm²"}

# Limits above which a value is out of its domain.
LIMITS = {"remanent_polarization_Pr": 100.0, "double_remanent_polarization_2Pr": 200.0, "coercive_field_Ec": 10.0}
TWO_PR = r"(?i)\b2\s*\.?\s*P\s*\.?\s*r\b"
TWO_PR_SAID = r"(?i)\b2\s*\.?\s*P\s*\.?\s*r\b|2Pr|double remanent"
SECONDARY = r"(?i)\[[\d,\-\s]+\]|previous(?:ly)? reported|literature|reported by"
# Material families, phases and properties of the schema.
FAMILIES = ["HfO2", "HZO", "Si:HfO2", "Al:HfO2", "La:HfO2", "Y:HfO2", "Gd:HfO2", "Sr:HfO2", "mixed_doped_HfO2", "unknown_hafnia"]
PHASE_NAMES = ["monoclinic", "orthorhombic", "tetragonal", "cubic", "rhombohedral", "amorphous", "mixed", "unknown"]
PROPERTY_NAMES = ["remanent_polarization_Pr", "double_remanent_polarization_2Pr", "coercive_field_Ec", "saturation_polarization_Ps", "dielectric_constant", "leakage_current_density", "endurance_cycles", "retention_time", "memory_window", "wake_up", "fatigue", "breakdown_field", "band_gap"]
SOURCE_TYPES = ["text", "table", "figure_caption", "abstract", "metadata", "manual"]

# Measured properties: name, pattern (value in group 1, unit prefix in group 2 if any), raw name, default unit.
POLAR_UNIT = r"(?:μ|µ|u)?C\s*/?\s*cm(?:\^?2|²|−2|-2)"
PROPERTIES = [
    ("double_remanent_polarization_2Pr", rf"(?i)\b2\s*\.?\s*P\s*\.?\s*r\b[^.;,\n]{{0,80}}?([-+]?\d+(?:\.\d+)?)\s*{POLAR_UNIT}", "2Pr", "μC/cm²"),
    ("remanent_polarization_Pr", rf"(?i)\bP\s*\.?\s*r\b[^.;,\n]{{0,80}}?([-+]?\d+(?:\.\d+)?)\s*{POLAR_UNIT}", "Pr", "μC/cm²"),
    ("coercive_field_Ec", r"(?i)\bE\s*c\b[^.;,\n]{0,80}?([-+]?\d+(?:\.\d+)?)\s*(M|k)?V\s*/?\s*cm", "Ec", "MV/cm"),
    ("memory_window", r"(?i)memory window[^.;,\n]{0,80}?([-+]?\d+(?:\.\d+)?)\s*V\b", "memory window", "V"),
    ("endurance_cycles", r"(?i)endurance[^.;,\n]{0,80}?10\^?(\d+)\s*cycles?", "endurance", "cycles"),
]

# Materials in order: pattern, canonical name, family, dopants, zirconium fraction.
MATERIALS = [
    (r"Hf\s*0?\.?5\s*Zr\s*0?\.?5\s*O\s*2|Hf0\.5Zr0\.5O2|HZO", "Hf0.5Zr0.5O2", "HZO", ["Zr"], 0.5),
    (r"Hf\s*1\s*[-−]\s*x\s*Zr\s*x\s*O\s*2|Hf1-xZrxO2|HfZrO", "Hf1-xZrxO2", "HZO", ["Zr"], None),
    *[(rf"{el}[-\s]?doped\s+HfO2|{el}:HfO2", f"{el}:HfO2", f"{el}:HfO2", [el], None) for el in ("La", "Si", "Al", "Y", "Gd", "Sr")],
    (r"\bHfO2\b|hafnia|hafnium oxide", "HfO2", "HfO2", [], None),
]

# Phases in order: pattern, name, space group.
PHASES = [(r"orthorhombic|Pca\s*2\s*1|Pca21", "orthorhombic", "Pca21"), (r"monoclinic|P2\s*1/c|P21/c", "monoclinic", "P21/c"), (r"tetragonal|P42/nmc", "tetragonal", "P42/nmc"), ("rhombohedral", "rhombohedral", None), ("cubic", "cubic", None), ("amorphous", "amorphous", None)]
DEVICES = ["FeFET", "FTJ", "FeRAM", "capacitor", "memristor", "ReFET"]
DEPOSITIONS = ["ALD", "sputtering", "sputter", "PLD", "CSD", "sol-gel", "MOCVD"]
THICKNESS = r"(?i)\b(\d+(?:\.\d+)?)\s*nm[^.;,\n]{0,50}(film|HZO|HfO2|hafnia)"
ANNEAL = r"(?i)anneal[^.;\n]{0,80}?([-+]?\d+(?:\.\d+)?)\s*(?:°\s*)?C"
ELECTRODE = r"(?i)\b(TiN|W|Pt|RuO2|Ru|ITO|TaN)\b"
STACK = r"(?i)((?:TiN|W|Pt|RuO2|Ru|ITO|TaN|Si|SiO2|HZO|HfO2)[/\-\w. ]{5,80}(?:TiN|W|Pt|RuO2|Ru|ITO|TaN|Si))"
STACK_TOKEN = r"(?i)\b(TiN|HZO|HfO2|HfZrO|Pt|W|RuO2|Ru|ITO|TaN|SiO2|Si)\b"

# Words by which a question names a property or a material family, in order.
PROPERTY_ALIASES = {"double_remanent_polarization_2Pr": ["2pr", "2.pr", "double remanent", "双剩余", "双倍剩余"], "remanent_polarization_Pr": ["pr", "remanent polarization", "剩余极化"], "coercive_field_Ec": ["ec", "coercive", "矫顽"], "endurance_cycles": ["endurance", "cycles", "循环", "耐久"], "memory_window": ["memory window", "窗口"], "retention_time": ["retention", "保持"], "leakage_current_density": ["leakage", "漏电"]}
FAMILY_ALIASES = {"HZO": ["hzo", "hfzr", "hf0.5zr0.5o2", "hf1-xzrxo2", "zirconium", "zr", "铪锆"], "HfO2": ["hfo2", "hafnia", "hafnium oxide", "氧化铪"], "La:HfO2": ["la", "lanthanum", "la:hfo2", "la-doped"], "Si:HfO2": ["si", "silicon", "si:hfo2", "si-doped"], "Al:HfO2": ["al", "aluminum", "al:hfo2", "al-doped"], "Y:HfO2": [" y ", "yttrium", "y:hfo2", "y-doped"], "Gd:HfO2": ["gd", "gadolinium", "gd:hfo2", "gd-doped"], "Sr:HfO2": ["sr", "strontium", "sr:hfo2", "sr-doped"]}
ASK_2PR, ASK_EC, ASK_PR = r"(?i)\b2\s*\.?\s*pr\b|2\s*倍|双剩余|双倍剩余", r"(?i)\bec\b|矫顽", r"(?i)\bpr\b|剩余极化|remanent"
TOKEN = r"[A-Za-z0-9_+\-.μµ/²℃°]+|[\x{4e00}-\x{9fff}]+"

# What makes a title unusable, and words that a title can't end with.
BAD_TITLE = r"(?i)(^abstract\b|^keywords:|^received:|^accepted:|^revised:|^published\b|^copyright\b|^doi\b|https?://|^www\.|^article$|^research article$|^article in press$|^check for updates$|^advanced functional materials$|^nature communications$|^communications materials$|^npj\s*\|?\s*computational materials$|^mrs bulletin|^information sciences$|^hal id:|^open access$|^cite this article|^we are providing an unedited version)"
DANGLING = r"(?i)\b(of|for|in|with|and|to|from|by|via|toward|towards|using|on|the|a|an|or|as|at|for the|:)$"
TITLE_KEYWORDS = ["ferroelectric", "hfo", "hfo2", "hafnium", "hafnia", "hzo", "zro", "memory", "thin film"]
TITLE_NOISE = r"\b(et al|received|accepted|correspondence|copyright|volume|issue)\b"
ELEMENT = "(Hf|Zr|Ce|Si|Al|La|Y|Gd|Sr|Ti)"
# Ordered rewrites that clean a title (pattern, replacement with $ groups).
TITLE_REWRITES = [
    (r"(?i)<\s*sub\s*>(.*?)<\s*/\s*sub\s*>", "$1"), (r"(?i)<\s*/?\s*i\s*>", ""), (r"<[^>]+>", ""), (r"\\text\{([^}]*)\}", "$1"), (r"\\mathrm\{([^}]*)\}", "$1"), (r"_\{([^}]*)\}", "$1"), (r"\$", ""),
    (r"(?i)\s+at\s+arxiv:\S+\s+\[[^\]]+\]\s+\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+", " at "), (r"\x00", " "), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"),
    (r"(?i)\bfi\s+lm(s?)\b", "film$1"), (r"(?i)\bfl\s+exible\b", "flexible"), (r"(?i)\barti\s+fi\s+cial\b", "artificial"), (r"(?i)\be\s+ff\s+ect(s?)\b", "effect$1"), (r"(?i)\bdetention insights\b", "retention insights"),
    ("[\u00a0\u2000-\u200a]", " "), (r"\s+", " "), (r"\s+([:;,.)])", "$1"), (r"([(])\s+", "$1"), (rf"\b{ELEMENT}\s+([0-9]+(?:\.[0-9]+)?)\b", "$1$2"), (rf"\b{ELEMENT}O\s+([0-9])\b", "$1O$2"), (r"\bO\s+([0-9])\b", "O$1"),
    (r"(?i)\bWO\s*3\s*[–−-]\s*x\b", "WO3-x"), (r"\bHf0\s+5Zr0\s+5O2\b", "Hf0.5Zr0.5O2"), (r"\bHf0\.5\s+Zr0\.5\s+O2\b", "Hf0.5Zr0.5O2"), (r"\s*/\s*", "/"), (r"\s*-\s*", "-"),
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
