"""Source text with literals emptied and brackets paired, one text at a time.

The result keeps the lines of the text. Marks are written around control characters, so patterns
can use what no bounded pattern can count:

    \\x01<line>.<column>.<pair>\\x02  behind every bracket and line end (pair is empty for line ends)
    \\x04  before a word or bracket where a value is expected
    \\x05  ... behind a modifier, `function`, `new`, `abstract` or `*`
    \\x06  ... where no arrow function can start
    \\x07  ... behind `function`, `new` or `class`

Lines count from 1, columns from 0, both without marks. A bracket and its partner carry the same
pair number; brackets without a partner carry one that occurs once.

Type lists in angle brackets are left out of typed scripts (their line ends stay): a `<` opens one
only if what follows reads as types up to its `>` and what stands behind that cannot go on a
comparison; otherwise it is taken back and stays an operator. Annotations that hold functions or methods
are left out in the same way, so they start no unit and call nothing.
"""

import re

_CODE = re.compile(
    r"(?P<comment>//[^\n]*|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))"
    r"|(?P<string>\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?)"
    r"|(?P<word>[^\W\d][\w$]*|[$][\w$]*|\d[\w$]*)|(?P<blank>[ \t\r\f\v]+)|(?P<sign>.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.|\$(?!\{))*+", re.S)
_RUST = re.compile(
    r"(?P<comment>//[^\n]*|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))"
    r"|(?P<string>b?r(?P<hashes>#*)\".*?\"(?P=hashes)|b?\"(?:[^\"\\]++|\\.)*+\"?|b?'(?:[^'\\\n]|\\(?:u\{[^}\n]*\}|x[0-9A-Fa-f]{2}|[^\n]))')"
    r"|(?P<word>\w+)|(?P<blank>[ \t\r\f\v]+)|(?P<sign>.)",
    re.S,
)
_PYTHON = re.compile(
    r"(?P<string>(?P<prefix>[rRbBuUfF]{0,2})(?:\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+(?:\"\"\"|\Z)|'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\Z)"
    r"|\"(?:[^\"\\\n]++|\\.)*+\"?|'(?:[^'\\\n]++|\\.)*+'?))"
    r"|(?P<comment>#[^\n]*)|(?P<word>\w+)|(?P<join>\\\r?\n)|(?P<sign>.)",
    re.S,
)
_FIELD = re.compile(r"\{[^{}\n]*\}")

_IN_TYPES = re.compile(
    r"(?P<blank>(?:[ \t\r\f\v]++|//[^\n]*|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))++)|(?P<line>\n)"
    r"|(?P<string>\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`)"
    r"|(?P<word>[\w$]+)|(?P<sign>=>|\.\.\.|[=|&?]=|\|\||&&|\?\?|.)",
    re.S,
)
_WAITS = re.compile(r"\s*[^\s.?:),;=]")  # behind a `?` that asks
_PARAMETERS = re.compile(r"\(\s*(?:\)|\.\.\.|[{\[]|[\w$]+\s*(?:[:,?=]|\)\s*=>))")  # of a function type, no type in parentheses
_PLAIN_NAME = re.compile(r"[\w.$@/:-]*")
# Words that no type holds, that ask for a type behind them, and that follow one.
NOT_IN_TYPES = set("return if else for while do switch case break continue let var class await yield throw delete instanceof try catch".split())
ASK_TYPE = set("keyof typeof readonly infer unique asserts in out const new abstract extends is as get set".split())
BEHIND_TYPE = set("extends implements is as in out of satisfies instanceof".split())

VALUE_WORDS = set("return typeof new void delete in of yield await throw case do else instanceof".split())
VALUE_SIGNS = set("=(,:?[!&|+~<>*%^-")
MODIFIERS = set("static async get set public private protected override readonly function new abstract".split())
CLOSES = {")": "(", "]": "[", "}": "{"}


class Marked:
    """Output with positions; brackets are paired as they close."""

    def __init__(self):
        self.parts, self.line, self.col = [], 1, 0
        self.open = {"(": [], "[": [], "{": []}
        self.pairs = 0

    def add(self, text):
        if "\n" not in text:
            self.parts.append(text)
            self.col += len(text)
            return
        for i, piece in enumerate(text.split("\n")):
            if i:
                self.parts.append(f"\n\x01{self.line}.{self.col}.\x02")
                self.line, self.col = self.line + 1, 0
            self.parts.append(piece)
            self.col += len(piece)

    def flag(self, marks):
        self.parts.append(marks)

    def bracket(self, sign):
        if sign in self.open:
            self.pairs += 1
            pair = self.pairs
            self.open[sign].append(pair)
        elif self.open[CLOSES[sign]]:
            pair = self.open[CLOSES[sign]].pop()
        else:
            self.pairs += 1
            pair = self.pairs
        self.parts.append(f"{sign}\x01{self.line}.{self.col}.{pair}\x02")
        self.col += 1

    def text(self):
        return "".join(self.parts)


def _behind_types(text, at):
    """Whether what stands at `at`, behind a `>`, lets that close a list of types."""
    line = False
    while at < len(text):
        found = _IN_TYPES.match(text, at)
        if found.lastgroup not in ("blank", "line"):
            break
        line, at = line or found.lastgroup == "line", found.end()
    else:
        return True
    if found.lastgroup == "word":
        return line or found[0] in BEHIND_TYPE
    return found[0][0] in "({[`,;)]}:?.|&=" or line and found[0] != ">"


def type_list(text, start, refused, prefix=False):
    """End of the list of types whose `<` stands at `start`, or None if it opens no such list.

    `refused` collects the places of all `<` that the pass has shown to open none, so that no text
    is read again for each of them. A list before a parameter list (`prefix`) must hold a comma or
    `extends`, as markup may open in the same way.
    """
    stack = [["<", start, False]]  # bracket, place, whether a comma or `extends` stands directly inside
    inner = []  # lists closed inside, right before another `>`
    at, before, word_before, line = start + 1, "<", False, False
    while at < len(text):
        found = _IN_TYPES.match(text, at)
        kind, token = found.lastgroup, found[0]
        place, at = at, found.end()
        if kind == "blank":
            continue
        if kind == "line":
            line = True
            continue
        top = stack[-1]
        if kind in ("word", "string"):
            if token in NOT_IN_TYPES:
                break
            # Two types do not stand side by side, but on two lines of an object type.
            apart = not word_before or before in ASK_TYPE or token in BEHIND_TYPE or line and top[0] == "{"
            if not apart and not (top[0] == "{" and before in ("static", "async")):
                break
            top[2] = top[2] or token == "extends"
            word_before = True
        elif token in "([{<":
            stack.append([token, place, False])
            word_before = False
        elif token in ")]}":
            if CLOSES[token] != top[0]:
                break
            stack.pop()
            word_before = True
        elif token == ">":
            if top[0] != "<" or before == "<":
                break
            stack.pop()
            if not stack:
                if _behind_types(text, at) and (not prefix or top[2]):
                    if text[at : at + 1] != "=" or text[at : at + 2] == "=>":
                        return at
                break
            if re.compile(r"\s*>").match(text, at):
                inner.append(top[1])
            word_before = True
        elif token == ";" and top[0] != "{" or token == "=" and top[0] != "<":
            break
        elif token == "?" and top[0] == "<" and not top[2]:
            break
        elif token in "+-" and not (top[0] == "{" or text[at : at + 1].isdigit()):
            break
        elif token not in ("=>", "...", ";", "=", ",", ".", "|", "&", "?", ":", "+", "-"):
            break
        else:
            top[2] = top[2] or token == ","
            word_before = False
        before, line = token, False
    refused.update(inner)
    refused.update(place for sign, place, _ in stack if sign == "<")
    refused.add(start)
    return None


def _closing(text, place, refused):
    """Position behind the partner of the bracket at `place`, or None; `refused` as for `type_list`."""
    stack, at = [], place
    while at < len(text) and place not in refused:
        found = _IN_TYPES.match(text, at)
        token = found[0]
        if token in ("(", "[", "{"):
            stack.append((token, at))
        elif token in CLOSES:
            if stack[-1][0] != CLOSES[token]:
                break
            stack.pop()
            if not stack:
                return found.end()
        at = found.end()
    refused.update(p for _, p in stack)
    return None


def type_end(text, at, refused):
    """End of the one type that stands at `at`, or None."""
    end, need, group, line, choices = at, True, False, False, 0
    while at < len(text):
        found = _IN_TYPES.match(text, at)
        kind, token = found.lastgroup, found[0]
        place, at = at, found.end()
        if kind in ("blank", "line"):
            line = line or kind == "line"
            continue
        if line and not need and token not in ("|", "&", ".", "=>", "?", ":", "extends"):
            break
        behind, group, line = group, False, False
        if kind in ("word", "string"):
            if need:
                need = token in ASK_TYPE
            elif token in ("extends", "is"):
                choices += token == "extends"
                need = True
            else:
                break
        elif token in ("(", "{", "["):
            if not need and token != "[":
                break
            at = _closing(text, place, refused)
            if at is None:
                return None
            need, group = False, token == "(" and _PARAMETERS.match(text, place)
        elif token == "<":
            at = None if place in refused else type_list(text, place, refused)
            if at is None:
                break
        elif token == "=>" and not behind:
            break
        elif token in ("=>", "|", "&", ".") or choices and token == "?":
            need = True
        elif choices and token == ":":
            choices, need = choices - 1, True
        elif token != "-" or not need:
            break
        end = at
    return None if need else end


def _annotates(before, before_that, place):
    """Whether a `:` behind these tokens in this bracket stands before a type."""
    if before == ")":
        return place != "["
    if place in ("(", "field"):
        return True
    if place == "class":
        return before not in ("{", ";", ",")
    return place == "block" and before_that in ("let", "const", "var")


def _opens_object(before, before_that, braces):
    """Whether a `{` behind these tokens opens a value, so that `/` behind its `}` divides."""
    if before == ">" and before_that == "=":
        return False
    if before == ":":
        return bool(braces) and braces[-1] == "object"
    return before in VALUE_SIGNS or before in VALUE_WORDS and before not in ("do", "else")


def mark_typed(text):
    """TypeScript."""
    return mark_script(text, typed=True)


def mark_script(text, typed=False):
    """JavaScript and TypeScript; fields of template literals stay as code in parentheses.

    Plain text literals of computed names stay as written.
    """
    out, at, n = Marked(), 0, len(text)
    before, before_that = "", ""  # the last two tokens that are no blank or comment
    heads, head = [], ""  # the word before each open parenthesis, and before the last closed one
    braces = []  # open braces: "field" of a template, "object" or "block"
    squares = []  # open square brackets: whether a computed name may stand there
    refused, closed = set(), ""  # places of `<` that open no types; kind of the last closed brace
    places = [["block", 0]]  # open brackets, each with its `?` and `case` that wait for a `:`
    class_at, plain, returned = 0, 0, False  # depth at which the body of a class is due; end of types without functions
    while at < n:
        found = _CODE.match(text, at)
        kind, token = found.lastgroup, found[0]
        at = found.end()
        if kind in ("comment", "blank"):
            # Comments leave their line ends.
            out.add(token if kind == "blank" else "\n" * token.count("\n"))
            continue
        if kind == "string":
            named = squares and squares[-1] and _PLAIN_NAME.fullmatch(token[1:-1])
            out.add(token if named else '"' + "\n" * token.count("\n") + '"')
            before, before_that = '"', before
            continue
        if token == "\n":
            out.add(token)
            continue
        if token == "<" and typed and at - 1 not in refused:
            named = before.isidentifier() and before not in VALUE_WORDS or before == "." and before_that == "?"
            named = named or before[:1] in ("$", "#") or before == "]"
            end = type_list(text, at - 1, refused, prefix=not named)
            if end:
                out.add("\n" * text.count("\n", at, end))
                at = end
                continue
        if typed and kind == "word":
            if token == "class" and before != ".":
                class_at = len(places)
            elif token == "case":
                places[-1][1] += 1
        elif typed and token == "?" and _WAITS.match(text, at) and before != "?":
            places[-1][1] += 1
        types = token == "=" and before_that == "type" or token == "as" and before not in VALUE_SIGNS
        if token == ":" and places[-1][1]:
            places[-1][1] -= 1
            returned = False
        elif token == ":":
            types = _annotates(before, before_that, places[-1][0])
            returned = typed and types and before == ")"  # what follows is the type of a result
        if typed and types and at > plain:
            end = type_end(text, at, refused)
            if end and ("(" in text[at:end] or token == "="):
                out.add(("" if token == ":" else token) + "\n" * text.count("\n", at, end))
                at = end
                if token != ":":
                    before, before_that = token, before
                continue
            plain = end or at
        if token == "/":
            value = before in VALUE_SIGNS or before in VALUE_WORDS or before in ("", "{", ";")
            value = value and not (before in ("+", "-") and before == before_that)
            value = value or before == "}" and closed != "object"
            value = value or before == ")" and head in ("if", "while", "for", "with")
            literal = _REGEX.match(text, at - 1) if value else None
            if literal:
                at = literal.end()
                out.add('""')
                before, before_that = '"', before
                continue
        if token == "`" or token == "}" and braces and braces[-1] == "field":
            if token == "}":
                braces.pop()
                del places[max(len(places) - 1, 1) :]
                out.bracket(")")
            else:
                out.add('"')
            literal = _TEMPLATE.match(text, at)
            at = literal.end()
            out.add("\n" * literal[0].count("\n"))
            if text.startswith("${", at):
                at += 2
                out.bracket("(")
                braces.append("field")
                places.append(["field", 0])
                before, before_that = "(", before
            else:
                at += 1
                out.add('"')
                before, before_that = '"', before
            continue
        if kind == "word" or token in "([#*":
            flags = ""
            if before in VALUE_SIGNS or before in VALUE_WORDS:
                flags += "\x04"
            if before in MODIFIERS or before == "*":
                flags += "\x05"
            if before in ("async", "|", "&", "<") or before == ":" and returned:
                flags += "\x06"
            if before in ("function", "new", "class"):
                flags += "\x07"
            if flags:
                out.flag(flags)
        if token == "(":
            heads.append(before)
        elif token == ")":
            head = heads.pop() if heads else ""
        elif token == "{":
            braces.append("object" if _opens_object(before, before_that, braces) else "block")
            places.append(["class" if class_at == len(places) else braces[-1], 0])
            class_at = class_at if class_at < len(places) - 1 else 0
        elif token == "}":
            closed = braces.pop() if braces else "block"
        elif token == "[":
            squares.append(before in ("{", "}", ";", ",", "*") or before in MODIFIERS)
        elif token == "]" and squares:
            squares.pop()
        if token in "([":
            places.append([token, 0])
        elif token in ")]}":
            del places[max(len(places) - 1, 1) :]
        if token in "()[]{}":
            out.bracket(token)
        else:
            out.add(token)
        before, before_that = token, before
    out.add("\n")
    return out.text()


def mark_rust(text):
    out = Marked()
    for found in _RUST.finditer(text):
        kind, token = found.lastgroup, found[0]
        if kind == "hashes" or found["string"] is not None:
            out.add('"' + "\n" * token.count("\n") + '"')
        elif kind == "comment":
            out.add("\n" * token.count("\n"))
        elif token in "()[]{}" and kind == "sign":
            out.bracket(token)
        else:
            out.add(token)
    out.add("\n")
    return out.text()


def blank_python(text):
    """Comments dropped, strings emptied (f-string fields kept); \\x02 opens a continued line."""
    parts, stack, joined = [], [], []
    for found in _PYTHON.finditer(text):
        token = found[0]
        if found["string"] is not None:
            fields = " ".join(_FIELD.findall(token)) if found["prefix"].lower() in ("f", "rf", "fr") else ""
            parts.append('"' + fields + "\n\x02" * token.count("\n") + '"')
        elif found["comment"] is not None:
            continue
        elif found["join"] is not None:
            parts.append("\n\x02")
        else:
            if token in ("(", "[", "{"):
                stack.append((token, len(parts)))
            elif token in CLOSES and stack and stack[-1][0] == CLOSES[token]:
                start = stack.pop()[1]
                while joined and joined[-1][0] > start:
                    joined.pop()
                joined.append((start, len(parts)))
            parts.append(token)
    for start, end in joined:
        for i in range(start, end):
            if parts[i] == "\n":
                parts[i] = "\n\x02"
    return "".join(parts)
