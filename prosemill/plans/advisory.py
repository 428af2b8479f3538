"""

Blanks outside classes stand for any white space; operators.rules.prepared widens
them and gives rate rules the length gates of short documents.
"""

from __future__ import annotations

# Ids, patterns and parameters of the rules, in their set's order.
# ruff: noqa: E501, RUF001
# (id, flags, pattern, notable, more of match)
REGEX_RULES = [
    ("housestyle-em-dash", "g", r"—|\s–\s|\s--\s|\s—\s", {">": 0}, {}),
    ("housestyle-british-spelling", "gi", r"\b(?:(?:organi|recogni|reali|priorit|optimi|summari|minimi|maximi|standardi|categori|special|central|normali|utili|analy|apologi|emphasi)s(?:e|es|ed|ing|ation|ations)|behaviou?ral|behaviour|colour|favour|labour|honour|endeavour|neighbour|rumour|vapour|savour|flavour|harbour|centre|centres|metre|metres|litre|litres|theatre|fibre|calibre|defence|offence|licence(?:s|d)?|practise(?:s|d)?|programme|programmes|whilst|amongst|learnt|spelt|burnt|dreamt|modelling|modelled|travelling|travelled|labelling|labelled|cancelling|signalling|fuelled|counsellor)\b", {">": 0}, {}),
    ("consultant-key", "gi", r"""(?<!\b(?:api|ssh|gpg|pgp|rsa|aes|hmac|ssl|tls|oauth|jwt|private|public|secret|session|foreign|primary|composite|surrogate|natural|partition|sort|shard|encryption|decryption|signing|licen[sc]e|product|activation|access|registry|cache|hash|shift|caps|arrow|function|escape|answer|church|door|car|house|spare|piano|low|off)[\s-])\bkeys?\b(?!\s*[:=])(?!\s+(?:pair|pairs|value|values|store|stores|ring|rings|chain|chains|code|codes|file|files|id|ids|management|rotation|exchange|derivation|length|size|material|signature|signatures|holder|hole|holes|cutter|west|largo|lime|biscayne)\b)(?!\s+(?:to|of|is|are|was|were|in|on|at|for|and|or|that|which|from|with|under|by)\b)(?=\s+[a-z])""", {">": 0}, {}),
    ("consultant-focus", "gi", r"(?<!\b(?:in|out\s+of|sharp|soft|auto|manual|deep|shallow|camera|lens)\s)\bfocus(?:es|ed|ing|sed|sing)?\b(?!\s+(?:group|groups|puller|ring|length|distance|point\s+of|stacking))", {">=": 2, "per": 1000}, {}),
    ("consultant-drive", "gi", r"(?<!\b(?:hard|disk|floppy|flash|thumb|usb|ssd|tape|test|four-wheel|front-wheel|rear-wheel|golf|scenic)[\s-])\bdriv(?:e|es|ing|en)\b\s+(?:(?:by|the|a|an|our|their|its|his|her|significant|further|greater|real|long-term|short-term|sustainable|meaningful)\s+)*(?:growth|value|adoption|change|impact|performance|results?|revenue|efficiency|innovation|transformation|outcomes?|savings|productivity|engagement|alignment|scale|margins?|profit(?:ability)?|demand|synerg(?:y|ies)|improvements?|success|momentum|behaviou?rs?|uptake|penetration|conversion|retention|utili[sz]ation)\b", {">": 0}, {}),
    ("consultant-jargon", "gi", r"\b(?:synerg(?:y|ies|istic)|holistic(?:ally)?|best[- ]in[- ]class|world[- ]class|end[- ]to[- ]end|stakeholder alignment|operational(?:i[sz]e|i[sz]ed|i[sz]ing|i[sz]ation)|value proposition|go[- ]forward basis|net[- ]net|at the end of the day|mov(?:e|es|ed|ing) the needle|double[- ]click(?:ing)? on|lean(?:ing)? in(?:to)? (?:the|this|that|it)|(?<!(?:debt|financial|net|over|under|high|low)[-\s])leverag(?:e|es|ed|ing)(?! (?:ratio|ratios|multiple|multiples|level|levels|buyout|buyouts|loan|loans|finance|financing|credit|private equity))|boil the ocean|low[- ]hanging fruit|deep[- ]div(?:e|es|ing))\b", {">=": 3}, {"distinct": True}),
    ("consultant-context-words", "gi", r"(?:(?<!\b(?:distributionally|asymptotically)\s)\brobust(?:ness|ly)?\b(?!\s+(?:standard\s+errors?|estimator|estimators|regression|statistics|inference|check|checks|to\s+outliers|covariance))|(?<!\b(?:marine|forest|coral|natural|river|desert|soil|aquatic|terrestrial|freshwater|woodland|reef)\s)\becosystems?\b(?!\s+(?:services|restoration|collapse|biodiversity|degradation)))", {">=": 1, "per": 1000}, {}),
    ("machine-narration", "gi", r"""(?:^|[.!?]["')\]]?\s+|\n)\s*(?:In|Throughout) this (?:section|article|report|paper|chapter|analysis|piece|webinar)\b(?!\s+of\s+the\b)|\bwe(?:'ll| will| shall) (?:explore|examine|delve|dive into|unpack|walk through)\b|\blet(?:'s| us) (?:explore|examine|delve|dive into|unpack|walk through)\b|\bthe following (?:analysis|section|discussion|framework|considerations)\b|\bthere are (?:several|a number of|multiple|various) (?:factors|considerations|reasons|things|aspects|elements|points) to consider\b|\bthis (?:highlights|underscores|demonstrates|illustrates|reflects) the importance of\b|\bit(?:'s| is) (?:important|worth) (?:to note|noting|mentioning) that\b""", {">": 0}, {}),
    ("machine-vocabulary", "gi", r"\b(?:delv(?:e|es|ed|ing)|tapestr(?:y|ies)|realms?|beacons?|bolster(?:s|ed|ing)?|embark(?:s|ed|ing)? (?:on|upon)|foster(?:s|ed|ing)?|furthermore|moreover|notably|crucially|undeniably|remarkably|pivotal|seamless(?:ly)?|multifaceted|streamlin(?:e|es|ed|ing)|cutting[- ]edge|spearhead(?:s|ed|ing)?|underscor(?:e|es|ed|ing)|unveil(?:s|ed|ing)?|unwavering|vibrant|meticulous(?:ly)?|intricate(?:ly)?|intricacies|paramount|testament to)\b", {">=": 3}, {"distinct": True}),
    ("machine-phrases", "gi", r"\bin today's (?:rapidly evolving|fast[- ]paced|ever[- ]changing|increasingly complex)\b|\bin the (?:ever|rapidly)[- ]evolving (?:landscape|world|environment)\b|\bat its core\b|\bsheds? light on\b|\bserv(?:e|es|ed|ing) as a catalyst\b|\bpav(?:e|es|ed|ing) the way for\b|\bparadigm shift\b|\bstands? as a testament\b|\bplays? a (?:vital|crucial|pivotal|key) role\b|\bthe question is not (?:whether|if) .{1,60}? but when\b|\bthe interplay between\b|\bgame[- ]chang(?:er|ers|ing)\b|\bit(?:'s| is) not (?:just|merely|only) .{1,50}?[,;] (?:it|but)\b", {">": 0}, {}),
    ("machine-dead-metaphor", "gi", r"(?:(?<!\b(?:urban|rural|natural|physical|garden|desert|mountain|coastal|arid)\s)\blandscapes?\b(?!\s+(?:architect|architecture|gardening|design|painting|photography))|(?<!\b(?:train|bus|car|road|rail|sea|return|outward|overnight|long)\s)\bjourneys?\b(?!\s+(?:time|to work|home|by (?:train|car|bus|air)))|\bunlock(?:s|ed|ing)?\b(?=\s+(?:the\s+|a\s+|an\s+|its\s+|our\s+|their\s+|new\s+|significant\s+|further\s+|greater\s+)*(?:value|potential|growth|opportunit(?:y|ies)|savings|insight|insights|productivity|capacity|capabilit(?:y|ies)|synerg(?:y|ies)|benefits?)))", {">=": 1, "per": 1000}, {}),
    ("machine-transitions", "g", r"""(?:^|[.!?]["')\]]?\s+|\n)\s*(?:Furthermore|Moreover|Additionally|Consequently|Notably|Importantly|Crucially|Interestingly|Essentially|Fundamentally|Undeniably|Remarkably|Indeed)\s*,""", {">=": 0.6, "per": 1000}, {}),
    ("tight-hedge-stack", "gi", r"\b(?:may|might|could|can|would)\s+(?:potentially|possibly|arguably|conceivably|perhaps|likely)\b|\b(?:it|this)\s+(?:could|may|might)\s+be\s+(?:argued|said|suggested|posited|contended)\b|\b(?:somewhat|fairly|relatively|rather)\s+(?:likely|possible|unclear|uncertain|limited)\b|\b(?:appears?|seems?)\s+to\s+(?:potentially|possibly)\b|\bsuggests?\b[^.!?]{0,40}?\bmay (?:be|have|need|require)\b", {">": 0}, {}),
    ("tight-expletive-opener", "g", r"""(?:^|[.!?]["')\]]?\s+|\n)\s*(?:It|There)\s+(?:is|are|was|were|has been|have been|had been)\b""", {">=": 1, "per": 1000}, {}),
    ("tight-nominalisation", "gi", r"\bprovides? support for\b|\binvolves? the need for\b|\bimplement(?:s|ed|ing)? a reduction in\b|\b(?:conduct|perform|undertake|carry out)(?:s|ed|ing)? an? (?:analysis|assessment|review|evaluation|examination) of\b|\bmakes? a (?:decision|determination|recommendation|contribution)\b|\bgives? consideration to\b|\bprovides? an? (?:indication|explanation|overview) of\b|\bis (?:reflective|indicative|supportive|suggestive) of\b|\btakes? into (?:consideration|account) the\b|\bhas an? (?:impact|effect|influence) on\b|\bthe (?:deterioration|degradation|improvement|expansion|reduction|adjustment|implementation|utili[sz]ation|optimi[sz]ation|reassessment|acceleration|simplification) (?:in|of)\b|\b(?:has|have|had|is|are) creat(?:ed|ing|es)? an? need (?:to|for)\b|\bthere (?:is|was) an? need (?:to|for)\b", {">": 0}, {}),
    ("tight-empty-modifier", "gi", r"\b(?:comprehensive|innovative|nuanced|transformative|significant|substantial|considerable|meaningful|compelling|powerful|exciting|strategic)\s+(?!(?:deal|deals|buyer|buyers|acquirer|acquirers|investor|investors|rationale)\b)(?:[a-z]+\s+)?(?:approach|solution|framework|opportunit(?:y|ies)|capabilit(?:y|ies)|view|analysis|strategy|programme|program|initiative|transformation|change|impact|value|benefits?|insights?|understanding|shift|journey|platform|ecosystem|partnership)\b", {">": 0}, {}),
    ("tight-exclamation", "g", r"(?<![!\s])!(?!=)(?!\s*\[)", {">": 0}, {}),
    ("tight-long-sentences", "g", r"[.!?](?=\s|$)", {"<=": 13, "per": 1000, "needs": {"words": 150, "sentences": 2}}, {}),
    ("tight-passive", "gi", r"\b(?:is|are|was|were|be|been|being)\s+(?:\w+ly\s+)?\w+(?:ed|en)\b(?=\s+(?:by|in|on|at|for|with|to|from|during|through)\b|[.,;])", {">=": 6.3, "per": 1000}, {}),
    ("tight-agentless-passive", "gi", r"\b(?:an?|the) (?:[\w%-]+ ){0,3}(?:decline|increase|decrease|reduction|improvement|growth|shift|change|impact|effect|trend|gain|loss|deterioration|rise|fall|uptick|variance|discrepancy)\b[^.!?]{0,40}?\b(?:was|were|is|are|has been|have been) (?:observed|noted|identified|determined|reported|found|assessed|estimated|recorded|seen|measured)\b(?! by\b)", {">": 0}, {}),
    ("tight-summary-loop", "gi", r"""(?:^|[.!?]["')\]]?\s+|\n)\s*(?:In conclusion|To conclude|In summary|To summari[sz]e|To sum up|To recap|As (?:mentioned|noted|stated|discussed|outlined) (?:above|earlier|previously)|To reiterate|As we have seen|Having (?:established|shown))\b""", {">": 0}, {}),
    ("tight-rhetorical-question", "g", r"""(?:\?\s+(?:No|Yes|Not (?:really|quite|exactly)|Absolutely|Probably not|It (?:is|was)|It's|The answer is|Because|Simply put|In short)\b|(?:^|[.!?]["')\]]?\s+|\n)\s*(?:So )?(?:[Ww]hat|[Ww]hy|[Hh]ow) (?:does|do|did|is|are|was|were|should|can|could|might) (?:this|that|it|we|they|the [a-z]+) [^?\n]{0,50}\?)""", {">=": 0.5, "per": 1000}, {}),
    ("tight-triplet", "g", r"\b\w+,\s+\w+,\s+and\s+\w+\b", {">=": 5, "per": 1000}, {}),
]
FRAME_RULE = {"id": "tight-repeated-frame", "match": {"kind": "frame", "gram": 8, "minRun": 3, "anchors": 2}, "notable": {">": 0}, "default": "off", "severity": "warn"}

ADVISORY = [{"id": i, "match": {"kind": "regex", "pattern": p, "flags": f, **more}, "notable": n, "default": "off", "severity": "warn"} for i, f, p, n, more in REGEX_RULES]
ADVISORY.insert(-3, FRAME_RULE)

SET = {"name": "consultant", "version": "0.1.0", "rules": ADVISORY}
