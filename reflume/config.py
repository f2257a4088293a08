"""Settings of the studies. Functions take them as arguments; these are the defaults."""

from __future__ import annotations

# Study window, phrase registry, marker words and grids that results depend on.
FIRST_MONTH, LAST_MONTH, BREAK_MONTH = "2018-01", "2026-06", "2022-12"
BUFFER_MONTHS = 6
PHRASES = [
    "as an AI language model",
    "as a large language model, I",
    "as of my last knowledge update",
    "I cannot browse the internet",
    "I don't have access to real-time",
    "as an AI developed by OpenAI",
    "my knowledge cutoff",
]
ERA_YEAR = 2023
META_TITLE = (
    r"(chatgpt|gpt-?[345o]|large language|language model|\bllm\b|chatbot|"
    r"generative a\.?i\.?|artificial intelligence|ai-generated|ai text|"
    r"detect|plagiar|academic integrity)"
)
META_TERMS = [
    "language model", "chatgpt", "detect", "plagiar", "integrity",
    "artifact", "prevalence", "ai-generated", "generative ai", "chatbot",
]
META_SUBFIELDS = ["1702", "1703"]
KEPT_TYPES = ["article", "review", "book-chapter", "preprint", "dissertation"]
CONTROLS, TOLERANCE, POOL_CAP = 5, 0.25, 60
FUZZY_LEAST = 85.0
MARKERS = [
    "delve", "delves", "delving", "intricate", "intricacies", "intricately",
    "showcasing", "showcases", "showcased", "underscore", "underscores",
    "underscoring", "pivotal", "realm", "crucial", "crucially", "notably",
    "boasts", "meticulous", "meticulously", "commendable", "invaluable",
    "unwavering", "multifaceted", "nuanced", "paramount", "leverage",
    "leveraging", "seamless", "seamlessly", "holistic", "fostering",
    "elucidate", "elucidates", "elucidating", "unravel", "unraveling",
]
MARKERS_LEAST = 2
SENSITIVITIES = [0.03, 0.05, 0.10, 0.20]
SPECIFICITIES = [0.992, 0.995, 0.998, 0.999]
LEAST_REFS = 20
HAC_LAGS, LEAST_MONTHS = 6, 24

# Fixed values of the text checks: words and patterns that drafts should do without, and what counts as a hedge, an adverb or a passive.
BANNED = [
    "delve", "delving", "robust", "seamless", "crucial", "vital", "pivotal",
    "holistic", "synergy", "tapestry", "testament", "unlock", "empower",
    "elevate", "harness", "foster", "fostering", "realm", "game-changer",
    "cutting-edge", "utilize", "facilitate", "showcase", "showcasing",
    "underscore", "underscores", "interplay", "intricate", "vibrant",
    "groundbreaking", "notably", "moreover", "furthermore", "additionally",
]
EXEMPT_WORD = "robust"
EXEMPT_NEAR = r"(specification-robust|robust standard|robustness|(as|is|are|be|call it|describe it as) robust)"
EXEMPT_BEFORE, EXEMPT_AFTER = 45, 25
#: Words that are counted one by one in the wider list.
BANNED_WIDE = [
    "delve", "delves", "delving", "leverage", "leveraging", "leverages",
    "crucial", "vital", "pivotal", "seamless", "seamlessly", "holistic",
    "underscore", "underscores", "underscoring", "showcase", "showcases",
    "showcasing", "realm", "tapestry", "testament", "comprehensive",
    "extensive", "groundbreaking", "cutting-edge", "vibrant", "nestled",
    "breathtaking", "renowned", "stunning", "profound", "exemplifies",
    "intricate", "intricacies", "myriad", "plethora", "utilize", "utilizes",
    "facilitate", "facilitates", "foster", "fosters", "garner", "garners",
    "enduring", "indelible", "paramount", "meticulous", "meticulously",
    "commendable", "invaluable", "unwavering", "multifaceted", "nuanced",
    "elucidate", "elucidates", "unravel", "unraveling", "navigate",
    "navigating", "journey", "unlock", "unlocks", "empower", "empowers",
    "elevate", "elevates", "harness", "harnesses", "synergy", "interplay",
    "landscape", "revolutionize", "transformative", "remarkable",
    "noteworthy", "compelling", "robustly", "significantly", "notably",
]
QUOTED = r"``[^']*''"
PATTERNS = [
    ("serves_as", r"\bserves as\b"),
    ("stands_as", r"\bstands as\b"),
    ("boasts", r"\bboasts\b"),
    ("marks_a_shift", r"\bmarks a (shift|moment|turning)\b"),
    ("represents_a", r"\brepresents a\b"),
    ("is_a_testament", r"\bis a testament\b"),
    ("plays_a_key_role", r"\bplays a (key|critical|vital) role\b"),
    ("reflects_broader", r"\breflects broader\b"),
    ("setting_the_stage", r"\bsetting the stage\b"),
    ("highlighting", r",\s+highlighting\b"),
    ("underscoring", r",\s+underscoring\b"),
    ("emphasizing", r",\s+emphasizing\b"),
    ("reflecting", r",\s+reflecting\b"),
    ("symbolizing", r",\s+symbolizing\b"),
    ("showcasing", r",\s+showcasing\b"),
    ("ensuring", r",\s+ensuring\b"),
    ("fostering", r",\s+fostering\b"),
    ("experts_argue", r"\bexperts (argue|say|believe)\b"),
    ("studies_show", r"\bstudies (show|suggest|indicate)\b"),
    ("observers_have", r"\bobservers have\b"),
    ("it_is_believed", r"\bit is believed\b"),
    ("industry_reports", r"\bindustry reports\b"),
    ("despite_these_challenges", r"\bdespite these challenges\b"),
    ("future_outlook", r"\bfuture (outlook|prospects)\b"),
    ("not_only_but_also", r"\bnot only\b.{0,40}\bbut also\b"),
    ("it_is_not_just", r"\b(it is|it's) not just\b"),
    ("more_than_just", r"\bmore than just\b"),
    ("false_range", r"\bfrom \w+ to \w+, from \w+ to \w+"),
    ("em_dash", "\u2014"),
    ("en_dash_in_prose", "\\w\\s\u2013\\s\\w"),
    ("curly_quote", "[\u201c\u201d]"),
    ("emoji", "[\U0001f300-\U0001faff\u2600-\u27bf]"),
    ("in_order_to", r"\bin order to\b"),
    ("due_to_the_fact", r"\bdue to the fact\b"),
    ("at_this_point_in_time", r"\bat this point in time\b"),
    ("has_the_ability_to", r"\bhas the ability to\b"),
    ("important_to_note", r"\bit is important to note\b"),
    ("worth_noting", r"\bit is worth noting\b"),
    ("real_question", r"\bthe real question is\b"),
    ("at_its_core", r"\bat its core\b"),
    ("what_really_matters", r"\bwhat really matters\b"),
    ("heart_of_the_matter", r"\bthe heart of the matter\b"),
    ("lets_dive", r"\blet'?s (dive|explore|break)\b"),
    ("what_you_need", r"\bhere'?s what you need\b"),
    ("without_further_ado", r"\bwithout further ado\b"),
    ("in_conclusion", r"\bin conclusion\b"),
    ("overall", r"\bOverall,"),
    ("to_sum_up", r"\bto sum up\b"),
    ("the_future_looks", r"\bthe future looks\b"),
    ("exciting_times", r"\bexciting times\b"),
    ("hope_this_helps", r"\bI hope this helps\b"),
    ("as_of_my_last", r"\bas of my last\b"),
    ("low_profile", r"\bmaintains a low profile\b"),
    ("language_of", r"\bis the (language|currency|architecture) of\b"),
    ("becomes_a_trap", r"\bbecomes a trap\b"),
    ("honestly", r"\bHonestly\?"),
    ("heres_the_thing", r"\bhere'?s the thing\b"),
]
HEDGE_STACK = r"\b(may|might|could|possibly|potentially|perhaps|arguably|somewhat|relatively|generally|often|tend to|appears? to|seems? to)\b"
PROFILE_HEDGES = ["may", "might", "could", "appear", "appears", "suggest", "suggests", "seem", "seems", "likely", "possibly"]
CAUSAL = r"\b(causes?|caused|leads? to|drives?|results? in|produces?|because of|due to|attributable to)\b"
CALM = r"(\bp\s*=|\bCI\b|interval|\d+\.\d+|cannot|does not|no\b|not\b|may|might|consistent with|suggests?|would)"
ADVERB, PASSIVE = r"\b\w+ly\b", r"\b(is|are|was|were|been|being|be)\s+\w+(ed|en)\b"
NO_ADVERBS = ["only", "early", "likely", "family", "apply", "supply", "reply", "italy", "july", "multiply", "imply", "rely", "anomaly", "assembly"]
NO_ADVERBS_OF_SECTIONS = ["only", "early", "family", "apply", "monthly", "yearly", "roughly", "likely", "supply"]
VAGUE = r"\b(the (implications|reasons|results) are|is significant|are significant)\b"
FLOATS = ["figure", "table", "tabular", "thebibliography"]
