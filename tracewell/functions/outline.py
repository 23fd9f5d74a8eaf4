"""Outlines of source files: what is defined where, from one pass over strings, comments, braces and indentation; no grammar.

A definition is (line, end_line, depth, kind, name, signature): its first and last line from 1, how many definitions it stands in, and its head in one line. What is defined inside a function is left out, methods of classes are not. Strings and comments are blanked first, so nothing in them counts. Text that is cut off or not well formed gives what can be told: scopes that do not end, end with the file.
"""

from __future__ import annotations

import re
from bisect import bisect_left

#: Strings, comments and templates by language family; longer beginnings first.
BLANKED = {
    "python": re.compile(r"(?s)[rbfuRBFU]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|#[^\n]*"),
    "script": re.compile(r"(?s)//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?"),
    "go": re.compile(r"(?s)//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|`[^`]*`?|'(?:\\.|[^'\\\n])+'"),
    "rust": re.compile(r"(?s)//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"?|'(?:\\.[^']*|[^'\\\n])'"),
    "c": re.compile(r"(?s)//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'|^[ \t]*#(?:\\\n|[^\n])*", re.M),
}
FAMILY = {"python": "python", "javascript": "script", "typescript": "script", "tsx": "script", "go": "go", "rust": "rust", "java": "c", "c": "c", "cpp": "c"}
#: Heads of definitions by language: pattern, kind ('' if the first group is the kind), whether it needs a class around it. The first that fits decides.
NO_CALL = r"(?!(?:if|for|while|switch|catch|return|else|do|with|function|new|synchronized)\b)"
SCRIPT = [
    (r"\b(class|interface|enum|namespace)\s+(\w+)", "", False),
    (r"\bfunction\s*\*?\s*()(\w+)\s*[<(]", "function", False),
    (r"\b(?:const|let|var)\s+()(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=]+)?=>\s*$", "function", False),
    (rf"(?:^|\s|\*){NO_CALL}()(#?\w+)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?$", "method", True),
]
HEADS = {
    "javascript": SCRIPT,
    "typescript": SCRIPT,
    "tsx": SCRIPT,
    "go": [(r"^func\s+()(?:\([^)]*\)\s*)?(\w+)\s*[\[(]", "function", False), (r"^type\s+(?=\w+(?:\[[^\]]*\])?\s+(struct|interface)\s*$)(\w+)", "", False)],
    "rust": [(r"\bfn\s+()(\w+)", "function", False), (r"\b(struct|enum|trait|mod|union)\s+(\w+)", "", False), (r"\b(impl)\b(?:\s*<[^{]*?>)?\s+([^{]+?)\s*(?:where\b.*)?$", "", False)],
    "java": [(r"(?:^|\s)@?(class|interface|enum|record)\s+(\w+)", "", False), (rf"(?:^|[\s>\]]){NO_CALL}()(\w+)\s*\([^;=]*\)\s*(?:throws\s+[\w.,\s]+)?$", "method", True)],
    "c": [(r"\b(struct|enum|union|class|namespace)\s+(\w+)\s*(?:final\s*)?(?::[^{(]*)?$", "", False), (rf"(?:^|[\s*&]){NO_CALL}()(~?\w+(?:::~?\w+)*)\s*\([^;]*\)\s*(?:const|noexcept|override|\s)*(?::[^{{]*)?$", "function", False)],
}
HEADS["cpp"] = HEADS["c"]
COMPILED = {k: [(re.compile(p), kind, inside) for p, kind, inside in v] for k, v in HEADS.items()}
FUNCTIONS = {"function", "method"}
#: What a line of a script ends with if its statement goes on.
ON, NEXT = tuple(",=(:&|+-<>?."), re.compile(r"\s*\S")
PYTHON = re.compile(r"(?:async\s+)?(def|class)\s+(\w+)")
Definition = tuple[int, int, int, str, str, str]


def blanked(text: str, language: str) -> str:
    """The text with strings and comments as spaces; lines stay where they are."""
    return BLANKED[FAMILY[language]].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def head_of(language: str, head: str, in_class: bool) -> tuple[str, str] | None:
    for pattern, kind, inside in COMPILED[language]:
        if (in_class or not inside) and (m := pattern.search(head)):
            return kind or m[1], m[2].strip()
    return None


def in_braces(text: str, language: str) -> list[Definition]:
    code = blanked(text, language)
    breaks = [m.start() for m in re.finditer("\n", code)]
    out: list[list] = []
    stack: list[int | None] = []  # the definition that a brace opened
    begin = round_ = 0
    for m in re.finditer(r"[{}();\n]", code):
        c = m[0]
        if c in "()":
            round_ = max(0, round_ + (1 if c == "(" else -1))
        elif c == "{":
            held = [k for k in stack if k is not None]
            within = bool(held) and out[held[-1]][3] in FUNCTIONS
            head = " ".join(code[begin : m.start()].split())
            found = None if within or round_ else head_of(language, head, bool(held) and (not stack or stack[-1] is not None))
            if found:
                first = begin + len(code[begin : m.start()]) - len(code[begin : m.start()].lstrip())
                signature = " ".join(text[first : m.start()].split())
                out.append([bisect_left(breaks, first) + 1, 0, len(held), *found, signature])
            stack.append(len(out) - 1 if found else None)
            begin = m.end()
        elif c == "}":
            k = stack.pop() if stack else None
            if k is not None:
                out[k][1] = bisect_left(breaks, m.start()) + 1
            begin, round_ = m.end(), 0
        elif c == ";" and not round_:
            begin = m.end()
        elif c == "\n" and not round_ and FAMILY[language] in ("script", "go"):
            # a statement ends with its line, unless it goes on or its brace is on the next one
            if code[max(begin, m.start() - 200) : m.start()].rstrip()[-1:] not in ON and (NEXT.match(code, m.end()) or "{")[0][-1:] != "{":
                begin = m.end()
    end = text.count("\n") + 1
    return [tuple([x[0], x[1] or end, *x[2:]]) for x in out]


def by_indent(text: str) -> list[Definition]:
    code = blanked(text, "python")
    lines, shown = code.split("\n"), text.split("\n")
    out: list[list] = []
    stack: list[tuple[int, int]] = []  # indentation, definition
    round_ = last = 0
    for n, line in enumerate(lines):
        bare = line.strip()
        if bare and not round_:
            indent = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
            while stack and indent <= stack[-1][0]:
                out[stack.pop()[1]][1] = last
            m = PYTHON.match(bare)
            if m and not (stack and out[stack[-1][1]][3] == "function"):
                head, depth, to = "", 0, n
                while to < len(lines):  # to the colon behind the last bracket
                    head += ("" if to == n else " ") + shown[to].split("#")[0].strip() if lines[to].strip() else ""
                    depth += sum(lines[to].count(x) for x in "([{") - sum(lines[to].count(x) for x in ")]}")
                    if depth <= 0 and ":" in lines[to]:
                        break
                    to += 1
                out.append([n + 1, 0, len(stack), "function" if m[1] == "def" else "class", m[2], re.sub(r"\s*:[^:\])]*$", "", head)])
                stack.append((indent, len(out) - 1))
        round_ = max(0, round_ + sum(line.count(x) for x in "([{") - sum(line.count(x) for x in ")]}"))
        last = n + 1 if bare or shown[n].strip() else last
    for _, k in stack:
        out[k][1] = last
    return [tuple(x) for x in out]


def outline(text: str | None, language: str | None) -> list[Definition]:
    """The definitions of a source text; none of other languages."""
    if not text or language not in FAMILY:
        return []
    return by_indent(text) if language == "python" else in_braces(text, language)
