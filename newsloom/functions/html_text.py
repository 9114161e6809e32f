"""Text of an HTML page: its text nodes, each stripped, joined by one blank."""

from collections import Counter
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

# Text inside these elements is not page text.
HIDDEN = frozenset({"script", "style", "template", "rt", "rp"})
# Elements that never hold content.
VOID = frozenset(
    {
        "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
        "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
        "image", "isindex", "keygen", "menuitem", "nextid", "spacer",
    }
)


class _TextNodes(HTMLParser):
    """Collects text nodes; any markup between two runs of text ends a node."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.texts = []
        self._run = []
        self._open = []
        self._count = Counter()
        self._hidden = 0

    def _end_run(self):
        if self._run and not self._hidden:
            text = "".join(self._run).strip()
            if text:
                self.texts.append(text)
        self._run.clear()

    def handle_starttag(self, tag, attrs):
        self._end_run()
        if tag not in VOID:
            self._open.append(tag)
            self._count[tag] += 1
            self._hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self._end_run()

    def handle_endtag(self, tag):
        self._end_run()
        if self._count[tag]:
            closed = None
            while closed != tag:
                closed = self._open.pop()
                self._count[closed] -= 1
                self._hidden -= closed in HIDDEN

    def handle_data(self, data):
        self._run.append(data)

    def handle_charref(self, name):
        self._run.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self._run.append(html5.get(f"{name};", f"&{name}"))

    def handle_comment(self, data):
        self._end_run()

    def handle_decl(self, decl):
        self._end_run()

    def handle_pi(self, data):
        self._end_run()

    def unknown_decl(self, data):
        self._end_run()
        if data.upper().startswith("CDATA["):
            self._run.append(data[len("CDATA[") :])
            self._end_run()

    def close(self):
        super().close()
        self._end_run()


def html_to_text(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    return " ".join(parser.texts)
