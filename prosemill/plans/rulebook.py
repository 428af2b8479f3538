
from __future__ import annotations

from ..operators.rules import prepared
from . import advisory
from .examples import with_examples

# Ids, patterns and parameters of the rules, in their sets' order.
# ruff: noqa: E501, RUF001
WIKIPEDIA = [
    {"id": "ai-vocab", "match": {"kind": "regex", "pattern": r'\b(?:delv(?:e|es|ed|ing)|tapestr(?:y|ies)|meticulous(?:ly)?|pivotal|intricate(?:ly)?|intricacies|interplay|underscor(?:e|es|ed|ing)|garner(?:s|ed|ing)?|bolster(?:s|ed|ing)?|vibrant|bustling|multifaceted|seamless(?:ly)?|commendable|ever-evolving)\b', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "not-just", "match": {"kind": "regex", "pattern": r"\bnot\s+(?:just|only|merely|simply)\s+(?!because|when|if|since|though|although|that\b|as\b|to\b|in\s+order)[^.!?\n;]{1,50}?,?\s+but(?:\s+also)?\b|\b(?:it|this|that)(?:['\u2019]s|\s+(?:is|was))\s+not\s+[^.!?\n,;\u2014\u2013]{1,60}[,;\u2014\u2013]\s*(?:it|this|that)(?:['\u2019]s|\s+(?:is|was))\b", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "note-that", "match": {"kind": "regex", "pattern": r"\bit(?:['\u2019]s|\s+(?:is|was))\s+(?:also\s+)?(?:important|worth|crucial|essential|vital)\s+(?:to\s+(?:note|remember|understand|recognize|mention|pause|consider|ask)|noting|mentioning|remembering|pausing|considering|asking)\b(?:\s+that\b)?|\bit\s+should\s+be\s+noted\b", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "testament", "match": {"kind": "regex", "pattern": r'\b(?:stand|stands|stood|serve|serves|served|standing|serving)\s+as\s+(?:a|an)\s+(?:\w+\s+)?(?:testament|reminder)\b|\b(?:is|was|are|were|remain|remains)\s+a\s+(?:\w+\s+)?testament\s+to\b', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "crucial-role", "match": {"kind": "regex", "pattern": r'\bplay(?:s|ed|ing)?\s+(?:a|an)\s+(?:\w+\s+)?(?:crucial|pivotal|vital|key|significant|central|critical|important)\s+role\b', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "landscape", "match": {"kind": "regex", "pattern": r"\b(?:ever-)?(?:evolving|changing|shifting)\s+landscape\b|\bin\s+today['\u2019]s\s+(?:fast-paced|ever-changing|ever-evolving|digital|modern|competitive)\s+\w+", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "vague-experts", "match": {"kind": "regex", "pattern": r'\b(?:many|some|several|most|numerous)?\s*(?:experts|critics|observers|scholars|analysts|commentators)\s+(?:have\s+|often\s+|widely\s+)?(?:argu(?:e|es|ed)|not(?:e|es|ed)|suggest(?:s|ed)?|believ(?:e|es|ed)|agree[ds]?|contend(?:s|ed)?|observ(?:e|es|ed)|caution(?:s|ed)?|claim(?:s|ed)?|cit(?:e|es|ed)|point(?:s|ed)?\s+out)\b|\bindustry\s+reports?\s+(?:suggest|indicate|show)\w*\b', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "despite-challenges", "match": {"kind": "regex", "pattern": r'\bdespite\s+(?:these|those|such|its|their|the|numerous|significant|ongoing)\s+(?:\w+\s+)?challenges\b|\bfac(?:e|es|ed|ing)\s+(?:several|numerous|many|significant|various|a\s+number\s+of)\s+challenges\b|\bchallenges\s+remain\b|\bremains\s+to\s+be\s+seen\b|\b(?:only\s+)?time\s+will\s+tell\b', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "participle-tail", "match": {"kind": "regex", "pattern": r',\s+(?:highlighting|underscoring|emphasizing|showcasing|reflecting|demonstrating|illustrating|signaling|solidifying|cementing|reinforcing|underlining)\s+(?:its|his|her|their|our|the|a|an|how|that|what|both)\b[^.!?\n]*', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "promo", "match": {"kind": "regex", "pattern": r'\bnestled\s+(?:in|on|among|between|along|at)\b|\bin\s+the\s+heart\s+of\b|\brich\s+(?:cultural\s+|historical\s+)?(?:heritage|history|tapestry)\b|\bhidden\s+gem\b|\bmust-(?:visit|see|try)\b|\bbreathtaking\b|\bboasts?\s+(?:a|an|the)\b|\bstunning\s+(?:views?|scenery|architecture|backdrop)\b', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "ai-leftovers", "match": {"kind": "regex", "pattern": r"\bas\s+an\s+ai(?:\s+language)?\s+model\b|\bas\s+of\s+my\s+last\s+(?:update|training)\b|\bknowledge\s+cutoff\b|\bI\s+(?:cannot|can['\u2019]t|do\s+not|don['\u2019]t)\s+(?:browse\s+the\s+internet|access\s+real-?time)\b|contentReference|oaicite|turn0(?:search|news|image)\d*|attributableIndex|utm_source=", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
]
CLICHES = [
    {"id": "no-chain", "match": {"kind": "chain", "pattern": r'\bno[-\s][^,.;:!?\n\u2013\u2014\u2026]*(?:(?:\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+|\s*[;&\u2013\u2014]\s*(?:and\s+|or\s+)?|\s+-{1,2}\s+)no[-\s][^,.;:!?\n\u2013\u2014\u2026]*)+', "flags": "gi", "headTest": r'^no[-\s]'}, "notable": {">": 0}, "severity": "warn"},
    {"id": "whole", "match": {"kind": "regex", "pattern": r"\b(?:that|this)(?:['\u2019]s|\s+(?:is|was))\s+the\s+whole\b(?:\s+\w+)?", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "did-not-chain", "match": {"kind": "chain", "pattern": r"\b(?:did\s+not|didn['\u2019]t)\s[^,.;:!?\n\u2013\u2014\u2026]*(?:(?:\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or)\s+|\s*[;&\u2013\u2014]\s*(?:and\s+|or\s+)?|\s+-{1,2}\s+)(?:did\s+not|didn['\u2019]t)\s[^,.;:!?\n\u2013\u2014\u2026]*)+", "flags": "gi", "headTest": r"^(?:did\s+not|didn['\u2019]t)\s"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "dont-verb-it", "match": {"kind": "regex", "pattern": r"""\b(?:do\s+not|don['\u2019]t)\s+(?:just\s+|simply\s+|merely\s+)?(\w+)(?:\s+(?:of|about|at|on|for|with|to))?\s+it\b[^.!?\n]*?[.!?;,:\u2013\u2014]['"\u201d\u2019]*\s*(?:just\s+|simply\s+|merely\s+)?\1(?:\s+(?:of|about|at|on|for|with|to))?\s+it\b""", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "sit-with", "match": {"kind": "regex", "pattern": r'\bsit(?:s|ting)?\s+with\s+(?:that|this|it|(?:the|your)\s+(?:discomfort|feelings?|tension|weight|uncertainty|ambiguity|grief|silence|unease))\b(?:\s+for\s+a\s+\w+)?', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "already-know", "match": {"kind": "regex", "pattern": r'\byou\s+already\s+knows?\s+(?:the\s+answer|what|how|why|this|that|it|who|where)\b|\byou\s+already\s+knows?\b(?![ \t]+\w)', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "is-the-entire", "match": {"kind": "regex", "pattern": r"(?:\b(?:is|was|are|were)|['\u2019]s)\s+the\s+entire\b(?:\s+\w+)?", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "the-entire-is", "match": {"kind": "regex", "pattern": r"\bthe\s+entire\s+[\w'\u2019-]+(?:\s+[\w'\u2019-]+){0,4}?\s+(?:is|was|are|were)\b", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "is-real", "match": {"kind": "regex", "pattern": r'\bis\s+(?:(?:the|a)\s+real\b(?![\s-]+(?:estate|time|life|world|quick)\b)[^.!?\n]*?\b(?:and|not)\s+it\b|real\b(?![\s-]+(?:estate|time|life|world|quick)\b)[^.!?\n]*?\b(?:and|not)\b)', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "punchline", "match": {"kind": "regex", "pattern": r'\bthe\s+punchline(?:\s+(?:is|was|being)\b|\s*[:?])', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "worth-naming", "match": {"kind": "regex", "pattern": r"(?:\b(?:is|are|was|were|feels?|felt|seems?|seemed)|['\u2019]s)\s+(?:\w+\s+){0,2}?worth\s+naming\b(?!\s+names\b)|\bworth\s+naming\s*:", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "not-nothing", "match": {"kind": "regex", "pattern": r"\b(?:that|this|it|which)(?:['\u2019]s|\s+(?:is|was))\s+not\s+nothing\b", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "is-the-whole", "match": {"kind": "regex", "pattern": r"(?:\b(?:is|was|are|were)|['’]s)\s+the\s+whole\b(?:\s+\w+)?|\bhere(?:['’]s|\s+is)\s+the\s+whole\b(?:\s+\w+)?", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "echo-triad", "match": {"kind": "echo", "minGram": 4, "minRun": 2}, "notable": {">": 0}, "severity": "warn"},
    {"id": "performative-honesty", "match": {"kind": "regex", "pattern": r"\bI\s+(?:will\s+not|won['’]t)\s+pretend\b|\b(?:I['’]ll|let['’]s|to)\s+be\s+(?:honest|clear|blunt|real)\b|(?:^|[.!?–—]\s+|\n)(?:Honestly|Look|Truthfully|Frankly)\s*,", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "thats-the-part", "match": {"kind": "regex", "pattern": r"\b(?:that|this|it)(?:['’]s|\s+(?:is|was))\s+the\s+part\b|\bthe\s+part\s+that\s+(?:makes|made|gets|got|keeps|kept)\s+(?:me|you|us|it)\b|\bmy\s+favou?rite\s+part\s+of\b", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "the-only-i-trust", "match": {"kind": "regex", "pattern": r"\bthe\s+only\s+[\w'’-]+(?:\s+[\w'’-]+){0,2}?\s+(?:I|you|we|it|he|she|they)\s+(?:trust|need|needs|care|want|wants|use|uses|believe)\b|\bthe\s+only\s+[\w'’-]+\s+that\s+(?:matters|counts|works|survives)\b", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "take-my-word", "match": {"kind": "regex", "pattern": r"\b(?:you\s+)?(?:do\s+not|don['’]t)\s+(?:have\s+to\s+)?take\s+my\s+word\s+for\s+(?:it|any\s+of\s+(?:it|this|that))\b", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "turns-out", "match": {"kind": "regex", "pattern": r'(?:^|[.!?–—]\s+|\n)Turns\s+out\b|\bit\s+turns\s+out\s+that\b', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "fits-in-your-head", "match": {"kind": "regex", "pattern": r'\b(?:hold|fit|fits|holds|held)\s+(?:it\s+)?in\s+your\s+head\b|\bbatteries[-\s]included\b|\bit\s+just\s+works\b|\bzero[-\s]config(?:uration)?\b|\bsane\s+defaults\b', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "stacked-questions", "match": {"kind": "question-chain", "minRun": 2}, "notable": {">": 0}, "severity": "warn"},
    {"id": "sentence-anaphora", "match": {"kind": "anaphora", "minRun": 3}, "notable": {">": 0}, "severity": "warn"},
    {"id": "colon-triple", "match": {"kind": "regex", "pattern": r""":\s+[a-z][^.!?;:\n,=\[\]\(\)\{\}"'\/\\|_~^%*+<>&#@$\u2192\u21d2\u2194\u00b0]{1,39},\s+[a-z][^.!?;:\n,=\[\]\(\)\{\}"'\/\\|_~^%*+<>&#@$\u2192\u21d2\u2194\u00b0]{1,39},\s+(?:and\s+|or\s+)?[a-z][^.!?;:\n,=\[\]\(\)\{\}"'\/\\|_~^%*+<>&#@$\u2192\u21d2\u2194\u00b0]{1,39}(?=[.!?\n])""", "flags": "g"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "heres-the-twist", "match": {"kind": "regex", "pattern": r"\bhere(?:['’]s|\s+is)\s+(?:the|a|my|one)\s+(?:twist|thing|catch|kicker|rub|problem|first|second|third|next|recent|real|best|worst|surprising|interesting|key|important)\b[\w\s-]{0,20}[:.]", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "x-is-dead", "match": {"kind": "regex", "pattern": r'\b[\w\s]{3,30}\s+(?:is|are)\s+dead\b|\blong\s+live\s+\w+', "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "thats-why-mattered", "match": {"kind": "regex", "pattern": r"\b(?:that|this)(?:['’]s|\s+(?:is|was))\s+why\b[^.!?\n]{0,80}?\b(?:matter(?:s|ed)?|count(?:s|ed)?)\b", "flags": "gi"}, "notable": {">": 0}, "severity": "warn"},
    {"id": "stranded-auxiliary", "match": {"kind": "regex", "pattern": r"[;:,]\s+[^.;:!?\n]{2,50}\s(?:did|does|do|was|were|is|are|has|have|had|can|could|would|will)(?:n['’]t)?\s*[.;]|\b(?:Maybe|Perhaps)\s+\w+[^.!?\n]{0,40}\s(?:would|could|might|should|did|had|was|is)(?:n['’]t)?\s+(?:have\s*)?\.", "flags": "g"}, "notable": {">": 0}, "severity": "warn"},
]
MEASURED_BACKWARDS = [
    {"id": "moreover", "match": {"kind": "regex", "pattern": r'(?:^|[.!?]\s+|\n)(?:Moreover|Furthermore|Additionally|Notably)\s*,', "flags": "gi"}, "notable": {">": 0}, "default": "off", "severity": "info"},
    {"id": "crucial", "match": {"kind": "regex", "pattern": r'\bcrucial\b', "flags": "gi"}, "notable": {">": 0}, "default": "off", "severity": "info"},
    {"id": "stock-metaphor", "match": {"kind": "regex", "pattern": r'\b(?:a\s+|the\s+)?double[- ]edged\s+sword\b|\blevel(?:s|ed|led|ing|ling)?\s+the\s+playing\s+field\b|\b(?:a\s+|the\s+)?level\s+playing\s+field\b|\b(?:a\s+|the\s+)?delicate\s+balancing\s+act\b|\b(?:a\s+|the\s+)?virtuous\s+cycle\b|\bfertile\s+ground\s+for\b|\b(?:a\s+|the\s+)?driving\s+force\s+behind\b|\bone[- ]size[- ]fits[- ]all\b|\b(?:a\s+|the\s+)?cautionary\s+tale\b', "flags": "gi"}, "notable": {">": 0}, "default": "off", "severity": "info"},
    {"id": "negation-correction", "match": {"kind": "regex", "pattern": r"\b(?:is|was|are|were|do|does|did|can|could|would)n['’]t\s+[^.!?\n]{3,70}[.!?]\s+(?:It|That|They|You)(?:['’]s|\s+(?:is|was|are|were|do|does|did))\b", "flags": "gi"}, "notable": {">": 0}, "default": "off", "severity": "info"},
    {"id": "uniform-sentence-length", "match": {"kind": "rhythm"}, "notable": {"<=": 0.4, "needs": {"words": 250, "sentences": 8}}, "default": "off", "severity": "info"},
]
HOUSE_STYLE = [
    {"id": "utilise", "match": {"kind": "regex", "pattern": r'\butili[sz]e[sd]?\b', "flags": "gi"}, "notable": {">": 0}, "severity": "error"},
    {"id": "chatgpt-refs", "match": {"kind": "regex", "pattern": r'\bfilecite\S*|turn\d+file\d+', "flags": "g"}, "notable": {">": 0}},
]

SETS = [
    with_examples(rule_set)
    for rule_set in (
        {"name": "wikipedia-ai", "version": "1.0.0", "rules": WIKIPEDIA},
        {"name": "cliches", "version": "1.0.0", "rules": CLICHES},
        {"name": "measured-backwards", "version": "0.1.0", "aliases": ["unreproduced"], "rules": MEASURED_BACKWARDS},
        {"name": "house-style", "version": "0.0.0", "rules": HOUSE_STYLE},
        prepared(advisory.SET),
    )
]
