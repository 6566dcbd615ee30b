"""Word lists, predicate inverses and patterns that results depend on, stated as they have to be."""

from __future__ import annotations

# Honorifics that a base form drops.
TITLES = [
    "king", "queen", "prince", "princess", "lord", "lady", "sir", "dame", "duke", "duchess", "count", "countess", "baron", "baroness", "earl", "mr",
    "mrs", "ms", "miss", "dr", "prof", "captain", "lieutenant", "general", "admiral", "father", "brother", "sister", "saint", "goddess", "god",
]

# Leading articles that a normal form drops.
ARTICLES = ["the", "a", "an", "le", "la", "les", "un", "une"]

# Words that are never entities, and vague words that the strict rule rejects too.
PRONOUNS = ["he", "she", "it", "they", "we", "you", "i", "me", "him", "her", "them", "us"]
GENERIC = ["speaker", "person", "someone", "something", "thing", "place", "time", "way"]

# Document types in the order that breaks ties between scores.
TYPES = ("technical", "conversational", "scientific", "narrative")
UNKNOWN = "unknown"

# Inverse predicates by document type, and those of every type ("").
INVERSES: dict[str, dict[str, str]] = {
    "narrative": {
        "FATHER_OF": "CHILD_OF",
        "MOTHER_OF": "CHILD_OF",
        "CHILD_OF": "PARENT_OF",
        "PARENT_OF": "CHILD_OF",
        "SIBLING_OF": "SIBLING_OF",
        "MARRIED_TO": "MARRIED_TO",
        "HELPS": "HELPED_BY",
        "FIGHTS": "FIGHTS",
        "SAVES": "SAVED_BY",
        "BETRAYS": "BETRAYED_BY",
        "LOVES": "LOVED_BY",
        "HATES": "HATED_BY",
        "LIVES_IN": "HOME_OF",
        "TRAVELS_TO": "VISITED_BY",
        "RULES": "RULED_BY",
        "BORN_IN": "BIRTHPLACE_OF",
        "CAUSES": "CAUSED_BY",
        "LEADS_TO": "RESULT_OF",
    },
    "technical": {
        "PART_OF": "CONTAINS",
        "CONTAINS": "PART_OF",
        "BELONGS_TO": "HAS_MEMBER",
        "COMPONENT_OF": "HAS_COMPONENT",
        "IS_A": "EXAMPLE_OF",
        "IS_TYPE_OF": "HAS_TYPE",
        "CAUSES": "CAUSED_BY",
        "ENABLES": "ENABLED_BY",
        "REQUIRES": "REQUIRED_BY",
        "DEPENDS_ON": "DEPENDENCY_OF",
        "PREVENTS": "PREVENTED_BY",
        "FOLLOWS": "PRECEDES",
        "PRECEDES": "FOLLOWS",
        "USED_FOR": "USES",
        "USED_BY": "USES",
    },
    "conversational": {
        "DISCUSSES": "DISCUSSED_BY",
        "MENTIONS": "MENTIONED_BY",
        "PROPOSES": "PROPOSED_BY",
        "DECIDES": "DECIDED_BY",
        "ASSIGNED_TO": "ASSIGNED_BY",
        "RESPONSIBLE_FOR": "RESPONSIBILITY_OF",
        "RESPONDS_TO": "RESPONSE_FROM",
        "REFERS_TO": "REFERENCED_BY",
    },
    "scientific": {
        "PROVES": "PROVEN_BY",
        "DISPROVES": "DISPROVEN_BY",
        "HYPOTHESIZES": "HYPOTHESIS_OF",
        "CONCLUDES": "CONCLUSION_OF",
        "USES_METHOD": "METHOD_USED_BY",
        "ANALYZES": "ANALYZED_BY",
        "FINDS": "FOUND_BY",
        "DISCOVERS": "DISCOVERED_BY",
        "SHOWS": "SHOWN_BY",
        "CITES": "CITED_BY",
        "SUPPORTS": "SUPPORTED_BY",
        "CONTRADICTS": "CONTRADICTED_BY",
        "EXTENDS": "EXTENDED_BY",
    },
    "unknown": {
        "RELATES_TO": "RELATES_TO",
        "CONNECTED_TO": "CONNECTED_TO",
    },
    "": {
        "RELATED_TO": "RELATED_TO",
        "SIMILAR_TO": "SIMILAR_TO",
        "DIFFERENT_FROM": "DIFFERENT_FROM",
        "CONNECTED_TO": "CONNECTED_TO",
        "ASSOCIATED_WITH": "ASSOCIATED_WITH",
        "HAS": "BELONGS_TO",
        "OWNS": "OWNED_BY",
        "CREATES": "CREATED_BY",
        "PRODUCES": "PRODUCED_BY",
        "CAUSES": "CAUSED_BY",
    },
}

# Example predicates by document type.
EXAMPLES: dict[str, list[str]] = {
    "narrative": ["FATHER_OF", "LOVES", "FIGHTS", "JOURNEYS_TO", "SAVES", "BETRAYS"],
    "technical": ["IS_A", "PART_OF", "CAUSES", "REQUIRES", "CONTAINS", "USED_FOR"],
    "conversational": ["DISCUSSES", "DECIDES", "ASSIGNED_TO", "PROPOSES", "AGREES_TO"],
    "scientific": ["HYPOTHESIZES", "PROVES", "CITES", "FINDS", "USES_METHOD", "CORRELATES_WITH"],
    "unknown": ["RELATES_TO", "CONNECTED_TO", "HAS", "IS_A"],
}

# Type patterns by language; the score of a type is the share of its patterns that a text has.
PATTERNS: dict[str, dict[str, list[str]]] = {
    "en": {
        "technical": [
            r"\d+\.\d+",
            r"\d+%",
            r"\b(is defined as|refers to|means|configure|endpoint)\b",
            r"^\s*[-•*]\s+",
            r"\b(step\s*\d|figure\s*\d|table\s*\d)\b",
            r"\b(must|shall|should|requires|use)\b",
            r"\b[A-Z]{2,}\b",
            r"\b(config|setup|install|parameter|function|method|command)\b",
        ],
        "conversational": [
            r"^[A-Z][a-z]+\s*:",
            r'"[^"]{10,}"',
            r"\b(said|asked|replied|answered|responded)\b",
            r"\b(I think|we should|let's|you're|I'm)\b",
            r"\?\s*$",
            r"\b(meeting|discussion|agenda|action item|follow.?up)\b",
        ],
        "scientific": [
            r"\(\d{4}\)",
            r"\bet al\.",
            r"\bp\s*[<>=]\s*0?\.\d+",
            r"\b(hypothesis|method|results|conclusion|abstract)\b",
            r"\b(study|research|experiment|data|sample|population)\b",
            r"\b(significant|correlation|analysis|statistical)\b",
            r"[A-Z][a-z]+\s+(&|and)\s+[A-Z][a-z]+",
        ],
        "narrative": [
            r"\b(he|she|they|it)\s+(was|were|had|went|saw|came|stood|returned)\b",
            r"\b(suddenly|meanwhile|later|finally|once|then|afterward)\b",
            r"\b(said|thought|felt|wondered|knew|believed|realized)\b",
            r"\b(the hero|the king|the queen|the goddess|the god|the warrior)\b",
            r"\b(journey|battle|quest|return|voyage|adventure|kingdom)\b",
            r"\b[A-Z][a-z]+\s+(returned|traveled|journeyed|fought|loved|died)\b",
            r"\b(cunning|brave|wise|beautiful|mighty|ancient)\b",
            r"\b(years|days|nights|moons|seasons)\s+(passed|went|ago)\b",
        ],
    },
    "fr": {
        "technical": [
            r"\d+\.\d+",
            r"\d+%",
            r"\b(est défini comme|signifie|correspond à|configurer)\b",
            r"^\s*[-•*]\s+",
            r"\b(étape\s*\d|figure\s*\d|tableau\s*\d)\b",
            r"\b(doit|doivent|faut|nécessite|utiliser)\b",
            r"\b[A-Z]{2,}\b",
            r"\b(configuration|paramètre|fonction|méthode|commande|installer)\b",
        ],
        "conversational": [
            r"^[A-ZÀ-Ý][a-zà-ÿ]+\s*:",
            r"«[^»]{10,}»",
            r'"[^"]{10,}"',
            r"\b(dit|demandé|répondu|déclaré|expliqué)\b",
            r"\b(je pense|nous devrions|on devrait|tu es|je suis)\b",
            r"\?\s*$",
            r"\b(réunion|discussion|ordre du jour|point d'action|suivi)\b",
        ],
        "scientific": [
            r"\(\d{4}\)",
            r"\bet al\.",
            r"\bp\s*[<>=]\s*0?\.\d+",
            r"\b(hypothèse|méthode|résultats|conclusion|résumé)\b",
            r"\b(étude|recherche|expérience|données|échantillon|population)\b",
            r"\b(significatif|corrélation|analyse|statistique)\b",
            r"[A-Z][a-zà-ÿ]+\s+(&|et)\s+[A-Z][a-zà-ÿ]+",
        ],
        "narrative": [
            r"\b(il|elle|ils|elles)\s+(était|étaient|avait|alla|vit|vint)\b",
            r"\b(soudain|pendant ce temps|plus tard|enfin|alors|ensuite)\b",
            r"\b(dit|pensa|sentit|se demanda|savait|croyait|réalisa)\b",
            r"\b(le héros|le roi|la reine|la déesse|le dieu|le guerrier)\b",
            r"\b(voyage|bataille|quête|retour|aventure|royaume)\b",
            r"\b[A-ZÀ-Ý][a-zà-ÿ]+\s+(retourna|voyagea|combattit|aima|mourut)\b",
            r"\b(rusé|brave|sage|belle|puissant|ancien)\b",
            r"\b(années|jours|nuits|lunes|saisons)\s+(passèrent|s'écoulèrent)\b",
        ],
    },
}

# Words whose presence tells the language.
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "was", "for", "that", "with"],
    "fr": ["le", "la", "les", "de", "du", "et", "est", "pour", "que", "avec", "un", "une", "dans", "à", "des"],
}


def inverse_pairs() -> list[tuple[str, str, str]]:
    """(document type or "", predicate, inverse) rows."""
    return [(kind, predicate, inverse) for kind, pairs in INVERSES.items() for predicate, inverse in pairs.items()]
