"""Own examples of the bundled rules: what each is to flag and to leave, and what to write in its place."""

from __future__ import annotations

# rule: (to flag, to leave, suggestion)
EXAMPLES = {
    "ai-vocab": ("The report delves into a tapestry of causes.", "The report looks at several causes.", "Name the thing plainly."),
    "not-just": ("The bridge is not just a road but also a landmark.", "The bridge is a road and a landmark.", "State what it is."),
    "note-that": ("It is important to note that the gate closes at six.", "The gate closes at six.", "State the fact alone."),
    "testament": ("The harbour stands as a testament to their work.", "They built the harbour in two years.", "Say what was done."),
    "crucial-role": ("Salt played a crucial role in the trade.", "Salt made up half of the trade.", "Say what it did."),
    "landscape": ("Shops must follow the evolving landscape.", "The landscape here is flat.", "Name what changes."),
    "vague-experts": ("Many experts have argued that the dam is safe.", "Two engineers of the county inspected the dam.", "Name who says so."),
    "despite-challenges": ("The town grew despite these challenges.", "The town grew although the mine had closed.", "Name the difficulty."),
    "participle-tail": ("Sales rose by a tenth, highlighting the need for stock.", "Sales rose by a tenth. More stock is needed.", "Make it a sentence with a claim."),
    "promo": ("The inn is nestled in the hills.", "The inn is in the hills.", "Say where it is."),
    "ai-leftovers": ("As an AI language model I have no view.", "I have no view on this.", "Delete it."),
    "no-chain": ("There were no lights, no doors, and no stairs.", "There were no lights.", "List what there was."),
    "whole": ("We waited an hour, and that's the whole story.", "He told us the whole story.", "Stop before it."),
    "did-not-chain": ("She did not call, did not write, and did not visit.", "She did not call.", "Say what she did."),
    "sit-with": ("Let us sit with that for a while.", "They sit with their friends.", "Say what to think about."),
    "already-know": ("Deep down you already know the answer.", "You already paid the fee.", "Give the answer."),
    "is-the-entire": ("This list is the entire plan.", "We read the entire plan.", "Drop the emphasis."),
    "the-entire-is": ("The entire plan is on one page.", "They changed the entire plan.", "Drop the emphasis."),
    "punchline": ("And the punchline is that nobody came.", "The comedian forgot his last line.", "Say it without the drum roll."),
    "worth-naming": ("There is one risk that is worth naming.", "There is one risk.", "Name it."),
    "not-nothing": ("Ten euros a week, and that is not nothing.", "Ten euros a week is a fair sum.", "Say how much it is."),
    "is-the-whole": ("Trust is the whole point.", "He ate the whole cake.", "Say the point."),
    "echo-triad": ("We saw the old red house. They saw the old red house.", "We saw the house. They painted a barn.", "Say it once."),
    "performative-honesty": ("I won't pretend this was easy.", "This was hard.", "Say it without the vow."),
    "thats-the-part": ("And that's the part nobody reads.", "We replaced the broken part.", "Name the part."),
    "take-my-word": ("You don't have to take my word for it.", "The figures are in the annex.", "Give the evidence."),
    "turns-out": ("The road was closed. Turns out the bridge had gone.", "The road was closed because the bridge had gone.", "State the finding."),
    "fits-in-your-head": ("The tool is small, and it just works.", "The tool has four commands.", "Say what it does."),
    "stacked-questions": ("Why now? Why here?", "Why now? The lease ended.", "Ask one, and answer it."),
    "sentence-anaphora": ("Ships sail. Ships sink. Ships rust.", "Ships sail. Some of them sink.", "Join or vary them."),
    "heres-the-twist": ("Here's the thing: it rained.", "It rained.", "Say it."),
    "x-is-dead": ("Some say the printed page is dead.", "The printed page is read less.", "Give the figures."),
    "thats-why-mattered": ("And that's why the vote mattered.", "The vote changed the law.", "Say what it changed."),
    "moreover": ("It rained. Moreover, it was cold.", "It rained and was cold.", "Join the sentences."),
    "crucial": ("Timing is crucial here.", "Timing decides the result here.", "Say what depends on it."),
    "stock-metaphor": ("Speed is a double-edged sword.", "Speed saves time and costs fuel.", "Name both sides."),
    "utilise": ("They utilised a ladder.", "They used a ladder.", "Write use."),
    "chatgpt-refs": ("The dam is safe filecite.", "The dam is safe.", "Delete it or cite the source."),
}


def with_examples(rule_set: dict) -> dict:
    """The set with the examples and suggestions of its rules; a rule's own stay."""
    out = []
    for r in rule_set["rules"]:
        e = EXAMPLES.get(r["id"])
        out.append(r if e is None else {"suggest": e[2], "tests": {"hit": [e[0]], "miss": [e[1]]}} | r)
    return rule_set | {"rules": out}
