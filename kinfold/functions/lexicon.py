"""Word lists and patterns that normalised records depend on.

Fixed values: records only normalise to the agreed forms with exactly these entries.
Tables go from a canonical form to its variants.
"""


def _by_variant(canonical: dict[str, list[str]], with_codes: bool = False) -> dict[str, str]:
    """From each variant to its canonical form, and from each code to itself if asked for."""
    variants = [(v, c) for c, listed in canonical.items() for v in ([c, *listed] if with_codes else listed)]
    return dict(variants)


NULL_WORDS = ["null", "none", "nan", "nil", "unknown"]
LANDMARK_RE = r"\b(near|nr|opp|opposite|behind|beside|besides|next to|pres de|en face)\b"
ALIAS_RE = r"^(.*?)\s+(?:dba|d b a|aka|a k a|fka|f k a|trading as|formerly)\s+(.+)$"
DOMAIN_RE = r"\.(com|net|org|biz|info|co\.in|in|fr|us|io)\s*$"
PRIVATE_RE = r"\b[pb]h?i?ra?i?[vb]h?e[td]h?\b"
LIMITED_RE = r"\blimi[td]h?e?[td]h?\b"
#: Letters without a decomposition, and what they are written as.
SPECIAL_LETTERS = {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}

NAME_WORDS = _by_variant({
    "corp": ["corporation", "corpn"],
    "inc": ["incorporated"],
    "co": ["company", "cmpny"],
    "ltd": ["limited", "limitet", "limitad", "limidhedh"],
    "pvt": ["private", "pvte", "praivet", "piraivet", "praibhet"],
    "cie": ["compagnie"],
    "bros": ["brothers"],
    "intl": ["international", "internationale"],
    "mfg": ["manufacturing"],
    "assoc": ["associates", "association", "associes"],
    "tech": ["technologies", "technology", "technologie"],
    "ctr": ["center", "centre"],
    "st": ["saint", "sainte", "ste"],
    "mt": ["mount"],
    "grp": ["group", "groupe"],
    "ent": ["enterprises", "enterprise", "entreprise", "entreprises"],
    "svc": ["services", "service"],
    "sys": ["systems", "system", "systemes"],
    "ind": ["industries", "industry", "industrie"],
    "sol": ["solutions", "solution"],
    "soc": ["societe", "society"],
    "ets": ["etablissements", "etablissement"],
})
LEGAL = "inc corp co ltd pvt llc lp llp lllp pllc plc pc opc sarl sas sasu sa eurl sci snc scop scs selarl ei eirl cie gmbh ag bv srl spa pty pte".split()
WEAK = "shri sri shree sree smt the".split()
NAME_STOP = "and of de des du la le les et da".split()
SQUASH_DROP = LEGAL + WEAK + NAME_STOP + "limited private corporation incorporated company compagnie praivet piraivet limitet praibhet limidhedh".split()
#: Legal words as the context features write them, and as the duplicate checks know them.
CONTEXT_LEGAL = {"private": "pvt", "limited": "ltd", "corporation": "corp", "incorporated": "inc", "company": "co"}
FAMILY = (
    "group groupe holdings holding partners enterprises enterprise industries overseas ventures exports infratech public international intl global "
    "solutions services associates participations developpement distribution"
).split()

ADDRESS_WORDS = _by_variant({
    "rd": ["road"],
    "st": ["street", "str", "saint"],
    "ste": ["suite", "sainte"],
    "av": ["avenue", "ave", "aven"],
    "bd": ["boulevard", "blvd", "bld", "boul", "bvd"],
    "dr": ["drive", "drv"],
    "ct": ["court", "crt"],
    "ln": ["lane"],
    "pl": ["place"],
    "sq": ["square"],
    "hwy": ["highway"],
    "pkwy": ["parkway", "pky"],
    "cir": ["circle"],
    "ter": ["terrace"],
    "trl": ["trail"],
    "apt": ["apartment"],
    "fl": ["floor", "flr"],
    "bldg": ["building"],
    "n": ["north"],
    "s": ["south"],
    "e": ["east"],
    "w": ["west"],
    "ne": ["northeast"],
    "nw": ["northwest"],
    "se": ["southeast"],
    "sw": ["southwest"],
    "sec": ["sector"],
    "rue": ["r"],
    "all": ["allee"],
    "imp": ["impasse"],
    "chem": ["chemin"],
    "chaus": ["chaussee"],
    "fg": ["faubourg", "fbg"],
    "quai": ["qu"],
    "rte": ["route"],
    "mt": ["mount"],
    "ft": ["fort"],
    "hts": ["heights"],
    "jct": ["junction", "jn"],
    "nagar": ["ngr"],
})
ADDRESS_STOP = (
    "no number num of the de du des la le les d l et and near nr opp opposite behind beside besides next to tehsil teh dist district po ps cedex via at"
).split()

_US = _by_variant({
    "al": ["alabama"],
    "ak": ["alaska"],
    "az": ["arizona"],
    "ar": ["arkansas"],
    "ca": ["california"],
    "co": ["colorado"],
    "ct": ["connecticut"],
    "de": ["delaware"],
    "dc": ["district of columbia", "washington dc", "d c"],
    "fl": ["florida"],
    "ga": ["georgia"],
    "hi": ["hawaii"],
    "id": ["idaho"],
    "il": ["illinois"],
    "in": ["indiana"],
    "ia": ["iowa"],
    "ks": ["kansas"],
    "ky": ["kentucky"],
    "la": ["louisiana"],
    "me": ["maine"],
    "md": ["maryland"],
    "ma": ["massachusetts"],
    "mi": ["michigan"],
    "mn": ["minnesota"],
    "ms": ["mississippi"],
    "mo": ["missouri"],
    "mt": ["montana"],
    "ne": ["nebraska"],
    "nv": ["nevada"],
    "nh": ["new hampshire"],
    "nj": ["new jersey"],
    "nm": ["new mexico"],
    "ny": ["new york"],
    "nc": ["north carolina"],
    "nd": ["north dakota"],
    "oh": ["ohio"],
    "ok": ["oklahoma"],
    "or": ["oregon"],
    "pa": ["pennsylvania"],
    "ri": ["rhode island"],
    "sc": ["south carolina"],
    "sd": ["south dakota"],
    "tn": ["tennessee"],
    "tx": ["texas"],
    "ut": ["utah"],
    "vt": ["vermont"],
    "va": ["virginia"],
    "wa": ["washington"],
    "wv": ["west virginia"],
    "wi": ["wisconsin"],
    "wy": ["wyoming"],
    "pr": ["puerto rico"],
}, with_codes=True)
_INDIA = _by_variant({
    "ap": ["andhra pradesh", "telangana", "tg", "ts"],
    "ar": ["arunachal pradesh"],
    "as": ["assam"],
    "br": ["bihar"],
    "cg": ["chhattisgarh", "chattisgarh", "ct"],
    "ga": ["goa"],
    "gj": ["gujarat", "gujrat"],
    "hr": ["haryana"],
    "hp": ["himachal pradesh"],
    "jh": ["jharkhand"],
    "ka": ["karnataka"],
    "kl": ["kerala"],
    "mp": ["madhya pradesh"],
    "mh": ["maharashtra", "maharastra"],
    "mn": ["manipur"],
    "ml": ["meghalaya"],
    "mz": ["mizoram"],
    "nl": ["nagaland"],
    "od": ["odisha", "orissa", "or"],
    "pb": ["punjab"],
    "rj": ["rajasthan"],
    "sk": ["sikkim"],
    "tn": ["tamil nadu", "tamilnadu"],
    "tr": ["tripura"],
    "up": ["uttar pradesh"],
    "uk": ["uttarakhand", "uttaranchal", "ut"],
    "wb": ["west bengal"],
    "dl": ["delhi", "nct of delhi", "nct delhi"],
    "jk": ["jammu and kashmir"],
    "la": ["ladakh"],
    "py": ["puducherry", "pondicherry"],
    "ch": ["chandigarh"],
    "an": ["andaman and nicobar", "andaman and nicobar islands"],
    "dn": ["dadra and nagar haveli", "daman and diu", "dadra and nagar haveli and daman and diu"],
    "ld": ["lakshadweep"],
}, with_codes=True)
_FRANCE = _by_variant({
    "ara": ["auvergne rhone alpes", "ain", "allier", "ardeche", "cantal", "drome", "isere", "loire", "haute loire", "puy de dome", "rhone", "savoie", "haute savoie"],
    "bfc": ["bourgogne franche comte", "cote d or", "doubs", "jura", "nievre", "haute saone", "saone et loire", "yonne", "territoire de belfort"],
    "bre": ["bretagne", "cotes d armor", "finistere", "ille et vilaine", "morbihan"],
    "cvl": ["centre val de loire", "centre", "cher", "eure et loir", "indre", "indre et loire", "loir et cher", "loiret"],
    "cor": ["corse", "corse du sud", "haute corse"],
    "ges": ["grand est", "alsace", "lorraine", "ardennes", "aube", "marne", "haute marne", "meurthe et moselle", "meuse", "moselle", "bas rhin", "haut rhin", "vosges"],
    "hdf": ["hauts de france", "aisne", "nord", "oise", "pas de calais", "somme"],
    "idf": ["ile de france", "idf", "paris", "seine et marne", "yvelines", "essonne", "hauts de seine", "seine saint denis", "val de marne", "val d oise"],
    "nor": ["normandie", "calvados", "eure", "manche", "orne", "seine maritime"],
    "naq": ["nouvelle aquitaine", "charente", "charente maritime", "correze", "creuse", "dordogne", "gironde", "landes", "lot et garonne", "pyrenees atlantiques", "deux sevres", "vienne", "haute vienne"],
    "occ": ["occitanie", "ariege", "aude", "aveyron", "gard", "haute garonne", "gers", "herault", "lot", "lozere", "hautes pyrenees", "pyrenees orientales", "tarn", "tarn et garonne"],
    "pdl": ["pays de la loire", "loire atlantique", "maine et loire", "mayenne", "sarthe", "vendee"],
    "pac": ["provence alpes cote d azur", "paca", "region sud", "alpes de haute provence", "hautes alpes", "alpes maritimes", "bouches du rhone", "var", "vaucluse"],
})
#: State names and codes by country label; other countries have no states.
STATES = {"us": _US, "usa": _US, "united states": _US, "india": _INDIA, "france": _FRANCE, "fr": _FRANCE}

#: Names of Indian states in native scripts (fixed values).
NATIVE_STATES = {
    "Maharashtra": ["महाराष्ट्र"],
    "Delhi": ["नई दिल्ली", "दिल्ली"],
    "Haryana": ["हरियाणा"],
    "Uttar Pradesh": ["उत्तर प्रदेश"],
    "Uttarakhand": ["उत्तराखंड", "उत्तराखण्ड"],
    "Bihar": ["बिहार"],
    "Jharkhand": ["झारखंड", "झारखण्ड"],
    "Rajasthan": ["राजस्थान"],
    "Madhya Pradesh": ["मध्य प्रदेश", "मध्यप्रदेश"],
    "Chhattisgarh": ["छत्तीसगढ़"],
    "Himachal Pradesh": ["हिमाचल प्रदेश"],
    "Chandigarh": ["चंडीगढ़", "ਚੰਡੀਗੜ੍ਹ"],
    "Goa": ["गोवा"],
    "Gujarat": ["ગુજરાત", "गुजरात"],
    "Punjab": ["ਪੰਜਾਬ", "पंजाब"],
    "West Bengal": ["পশ্চিমবঙ্গ", "পশ্চিম বঙ্গ", "पश्चिम बंगाल"],
    "Assam": ["অসম", "আসাম"],
    "Tamil Nadu": ["தமிழ்நாடு", "தமிழ் நாடு", "तमिलनाडु"],
    "Karnataka": ["ಕರ್ನಾಟಕ", "कर्नाटक"],
    "Kerala": ["കേരളം", "കേരള", "केरल"],
    "Telangana": ["తెలంగాణ", "तेलंगाना"],
    "Andhra Pradesh": ["ఆంధ్రప్రదేశ్", "ఆంధ్ర ప్రదేశ్", "आंध्र प्रदेश"],
    "Odisha": ["ଓଡ଼ିଶା", "ଓଡିଶା", "ओडिशा"],
}
#: Patterns of names (fixed values): what is scrubbed in which order, consonant classes, and an abbreviation of private limited in Latin.
NAME_SCRUB = [
    (r"\d{7,}", " "),
    (r"^\s*www\s*\.", " "),
    (DOMAIN_RE, " "),
    (r"\.", ""),
    (r"[^\p{L}\p{N}]+", " "),
    (r"([a-z])0([a-z])", "$1o$2"),
    (r"([a-z])1([a-z])", "$1l$2"),
    (r"\b5([a-z]{3,})", "s$1"),
    (r"\b0([a-z]{2,})", "o$1"),
    (r"\s+", " "),
]
CONSONANTS = [
    ("ph|bh|b|p|f", "P"),
    ("kh|gh|ch|k|g|q|c", "K"),
    ("th|dh|t|d", "T"),
    ("sh|s|z|j", "S"),
    ("[vw]", "V"),
    ("[aeiouyh]", ""),
    (r"(.)\1+", "$1"),
]
FINAL_A_RE = "(?<=\\w\\w)(?<=[^aeiouāīūṛ\\W])a\\b"
PVT_LTD_RE = "pr[aā]\\s*\\.?\\s*li\\b\\.?"
