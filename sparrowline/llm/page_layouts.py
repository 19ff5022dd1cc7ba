"""Made pages with labelled blocks, from which the block labeller learns.

Each page lays out an article among menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, in markup of many kinds: elements that say what they are, `div`s whose class or id
says it, and `div`s that say nothing. Words are made up anew for each page, so that layout, shape and
context are learned, not a vocabulary; furniture often has the usual words in four languages.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "an ar be ch de do en er es ga he ie in ja ka le lo ma me mi na no on or ou pa que ra re ri sa se si so st ta te th ti to un ur va ve wi zu é ñ ü ä ö ç ê".split()
#: Words of furniture, by kind.
WORDS = {
    "nav": "Home|About|About us|Contact|News|Blog|Login|Sign in|Products|Services|Archive|Topics|Sports|Politics|Startseite|Über uns|Kontakt|Anmelden|Accueil|À propos|Connexion|Inicio|Acerca de|Contacto|Noticias|Next|Previous|Menu",
    "header": "Sign in|Search|Welcome|The Daily|My Account|Cart|Subscribe|Anmelden|Suche|Recherche|Buscar|Mon compte|Mi cuenta",
    "footer": "© 2024 Example Inc. All rights reserved.|Privacy Policy|Terms of Service|Imprint|Contact us|Impressum|Datenschutz|Mentions légales|Aviso legal|Alle Rechte vorbehalten.|Tous droits réservés.|Todos los derechos reservados.|Powered by|Follow us",
    "sidebar": "Related articles|Popular posts|Most read|Recommended|Trending now|Tags|Archives|Newsletter|Mehr zum Thema|Meistgelesen|Articles liés|Lo más leído|Artículos relacionados|Recent posts|Categories",
    "ad": "Advertisement|Sponsored|Buy now|Special offer|50% off|Shop now|Anzeige|Werbung|Publicité|Publicidad|Jetzt kaufen|Learn more|Click here|Limited time only!",
    "notice": "This site uses cookies.|We use cookies to improve your experience.|Accept all|Reject|Cookie settings|Diese Website verwendet Cookies.|Ce site utilise des cookies.|Este sitio utiliza cookies.|Subscribe to our newsletter|Enable notifications|I agree|Please disable your ad blocker",
    "form": "Name|Email|E-mail address|Password|Send|Submit|Search|Log in|Register|Your message|Absenden|Envoyer|Enviar|Suche|Country|Remember me",
    "comments": "Comments|3 Comments|Leave a comment|Reply|Kommentare|Commentaires|Comentarios|Antworten|Répondre|Responder|Report|Like|2 hours ago|Posted by anna|January 5, 2024 at 9:12|Load more comments",
}
#: Words of class, id or role of furniture, by kind.
NAMES = {
    "nav": "nav|menu|navbar|navigation|topnav|main-menu|breadcrumb|breadcrumbs|nav-links|pagination|site-nav|toc|tabs",
    "header": "header|site-header|masthead|top|topbar|page-header|branding|logo|banner-top|head",
    "footer": "footer|site-footer|bottom|copyright|colophon|page-footer|footer-links|legal|foot|credits",
    "sidebar": "sidebar|side|right-rail|widget|widgets|related|related-posts|recommended|popular|trending|aside|more-stories|secondary|read-more|tag-cloud",
    "ad": "ad|ads|advert|advertisement|ad-slot|sponsor|sponsored|promo|adsense|ad-container|banner-ad|promotion|dfp|teaser-ad|commercial",
    "notice": "notice|cookie|cookie-banner|consent|gdpr|alert|popup|modal|newsletter|cookie-notice|message|overlay|paywall|announcement|banner|disclaimer",
    "form": "form|search|search-form|login|signup|contact-form|subscribe|searchbox|newsletter-form|register|share|social|share-buttons",
    "comments": "comments|comment-list|comment-section|commentlist|disqus|replies|responses|discussion|reader-comments|comments-area|feedback|respond",
}
ARTICLE = "article|post|content|entry|entry-content|post-body|story|article-body|main-content|text|post-content|story-body|body-text|page-content|main|article-text|blog-post"
WRAPPERS = "wrapper|container|page|row|col|layout|site|inner|main-wrapper|grid|outer|app|root|section|col-md-8|box"
OWN_ELEMENT = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        self.lexicon = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 5))) for _ in range(60)]
        self.lexicon += ["the", "and", "of", "der", "und", "la", "que", "les", "de", "to"]
        #: How this page's words look: texts of any kind can be an article.
        self.style = rng.choices(["plain", "shouted", "numbers", "bare", "signs", "repeated"], [70, 8, 5, 7, 5, 5])[0]
        #: Pages whose names say nothing: `div`s and made-up classes only.
        self.mute = rng.random() < 0.12

    def sentence(self, least: int = 3, most: int = 16) -> str:
        words = self.rng.choices(self.lexicon, k=self.rng.randint(least, most))
        if self.style == "shouted":
            return self.rng.choice(["!! ", " ", "! "]).join(w.upper() for w in words) + self.rng.choice(["!!", "."])
        if self.style == "numbers":
            words = [str(self.rng.randrange(10 ** self.rng.randint(1, 6))) if self.rng.random() < 0.6 else w for w in words]
        if self.style == "signs":
            words = [self.rng.choice("#*=|/&%$@+<>") if self.rng.random() < 0.4 else w for w in words]
        if self.style in {"bare", "signs", "numbers"}:
            return html.escape(" ".join(words))
        return (" ".join(words)).capitalize() + self.rng.choice([".", ".", ".", "?", "!"])

    def prose(self, least: int = 1, most: int = 7) -> str:
        n = self.rng.randint(least, most) * self.rng.choice([1, 1, 1, 1, 1, 4])
        if self.style == "repeated":
            return " ".join([self.sentence()] * n)
        return " ".join(self.sentence() for _ in range(n))

    def phrase(self) -> str:
        return " ".join(self.rng.choices(self.lexicon, k=self.rng.randint(1, 4)))

    def open(self, tag: str, names: str = "", chance: float = 0.5) -> str:
        """A start tag; its class or id is one of `names`, or made up, or missing."""
        rng = self.rng
        if self.mute:
            tag = "div" if tag in {"nav", "header", "footer", "aside", "article", "main", "section"} else tag
            names = ""
        name = rng.choice(names.split("|")) if names and rng.random() < chance else rng.choice(self.lexicon) if rng.random() < 0.15 else ""
        if not name:
            return f"<{tag}>"
        name = name.replace("-", rng.choice(["-", "-", "_", " "]))
        attribute = rng.choice(["class", "class", "class", "id"])
        return f'<{tag} {attribute}="{name}">' if rng.random() < 0.9 else f"<{tag} {attribute}='{name}' data-x=1>"

    def add(self, start: str, text: str, end: str, label: bool) -> None:
        """A block of text; markup of its own never holds other blocks."""
        self.out.append(f"{start}{text}{end}")
        self.labels.append((label, text))

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and self.style != "signs" and self.rng.random() < 0.25:
            i = self.rng.randrange(len(words) - 2)
            tag = self.rng.choice(["b", "i", "em", "strong", "a href='/x'", "span", "code"])
            words[i], words[i + 1] = f"<{tag}>{words[i]}", f"{words[i + 1]}</{tag.split()[0]}>"
        return " ".join(words)

    def prose_block(self, tag: str, label: bool, most: int = 7) -> None:
        text = self.prose(1, most)
        self.out.append(f"<{tag}>{self.inline(text)}" + ("" if tag in {"p", "li"} and self.rng.random() < 0.1 else f"</{tag}>"))
        self.labels.append((label, text))

    def furniture(self, kind: str) -> None:
        rng = self.rng
        own = OWN_ELEMENT.get(kind)
        tag = own if own and rng.random() < 0.6 else rng.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        if kind == "sidebar" and tag == "section" and self.mute:
            tag = "div"
        self.out.append(self.open(tag, NAMES[kind], 0.35 if tag == own else 0.97))
        usual = [] if rng.random() < 0.45 else WORDS[kind].split("|")

        def words(prose: bool = False) -> str:
            return rng.choice(usual) if usual and rng.random() < 0.75 else self.prose(1, 3) if prose else self.phrase()

        if kind in {"nav", "sidebar"} or kind == "footer" and rng.random() < 0.4:
            if kind == "sidebar" and rng.random() < 0.7:
                self.add(f"<h{rng.randint(2, 4)}>", words(), "</h3>", False)
            inner = "" if tag == "ul" else rng.choice(["ul", "ul", "div", "ol"])
            self.out.append(f"<{inner}>" if inner else "")
            for _ in range(rng.randint(2, 8)):
                item = rng.choice(["li", "li", "li", "div"]) if inner != "ul" and tag != "ul" else "li"
                plain = kind == "sidebar" and rng.random() < 0.3
                text = words(prose=kind == "sidebar" and rng.random() < 0.4)
                self.add(f"<{item}>", text if plain else f'<a href="/{len(text)}">{text}</a>', f"</{item}>", False)
                self.labels[-1] = False, text
            self.out.append(f"</{inner}>" if inner else "")
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                self.add(*rng.choice([("<label>", words(), "</label><input name=q>"), ("<button type=submit>", words(), "</button>"), ("<p>", words(True), "</p>")]), False)
            if rng.random() < 0.3:
                self.out.append("<select name=c>")
                for _ in range(3):
                    self.add("<option>", words(), "</option>", False)
                self.out.append("</select>")
        elif kind == "comments":
            if rng.random() < 0.8:
                self.add("<h3>", words(), "</h3>", False)
            nested = rng.choice(["div", "div", "li", "article", "section"])
            for _ in range(rng.randint(1, 5)):
                self.out.append(self.open(nested, "comment|reply|comment-body|response|message|comment-item|depth-1", 0.8))
                if rng.random() < 0.6:
                    self.add(rng.choice(['<div class="author">', "<div>", '<p class="meta">']), words(), "</div>" if rng.random() < 0.5 else "</p>", False)
                for _ in range(rng.randint(1, 2)):
                    self.prose_block(rng.choice(["p", "p", "div"]), False, 4)
                if rng.random() < 0.3:
                    self.add("<div>", "<a href=#r>Reply</a>", "</div>", False)
                    self.labels[-1] = False, "Reply"
                self.out.append(f"</{'div' if self.mute and nested in {'article', 'section'} else nested}>")
        else:
            bare = rng.random() < 0.4
            for _ in range(1 if bare else rng.randint(1, 3)):
                inner = "" if bare else rng.choice(["p", "p", "div", "h1" if kind == "header" else "p", "button" if kind == "notice" else "p"])
                text = words(prose=rng.random() < 0.75)
                self.add(f"<{inner}>" if inner else "", text, f"</{inner}>" if inner else "", False)
        self.out.append(f"</{'div' if self.mute and tag in {'nav', 'header', 'footer', 'aside', 'section'} else tag}>")

    def article(self) -> None:
        rng = self.rng
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        self.out.append(self.open(tag, ARTICLE, 0.3 if tag in {"article", "main"} else 0.95))
        if rng.random() < 0.85:
            title = self.phrase() + " " + self.phrase() if rng.random() < 0.7 else self.sentence()
            inside = rng.random() < 0.15 and not self.mute
            self.out.append("<header>" if inside else "")
            self.add(rng.choice(["<h1>", "<h1>", "<h2>"]), title, "</h1>", True)
            self.out.append("</header>" if inside else "")
        inner = rng.random() < 0.3
        if inner:
            self.out.append(self.open("div", ARTICLE, 0.9))
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 5, 5, 8, 8, 12, 12, 40])):
            at = rng.random()
            if at < 0.7:
                self.prose_block("p", True)
            elif at < 0.76:
                self.add("<h2>", self.phrase(), "</h2>", True)
            elif at < 0.83:
                self.out.append(kind := rng.choice(["<ul>", "<ol>"]))
                for _ in range(rng.randint(2, 5)):
                    if rng.random() < 0.5:
                        self.prose_block("li", True, 2)
                    else:
                        self.add("<li>", self.phrase(), "</li>", True)
                self.out.append(f"</{kind[1:]}")
            elif at < 0.87:
                self.out.append("<blockquote>")
                self.prose_block("p", True, 3)
                self.out.append("</blockquote>")
            elif at < 0.90:
                self.add("<pre>", self.phrase(), "</pre>", True)
            elif at < 0.93:
                self.out.append("<table><tr>")
                for _ in range(rng.randint(2, 4)):
                    self.add("<td>", self.phrase(), "</td>", True)
                self.out.append("</tr></table>")
            elif at < 0.96:
                self.add("<figure><img src=a.png><figcaption>", self.sentence(), "</figcaption></figure>", True)
            else:
                self.furniture(rng.choice(["ad", "ad", "sidebar", "form", "notice"]))
        if inner:
            self.out.append("</div>")
        within = rng.random() < 0.3
        if within and rng.random() < 0.5:
            self.furniture("comments")
        self.out.append(f"</{'div' if self.mute and tag in {'article', 'main', 'section'} else tag}>")


def page(seed: int) -> tuple[str, list[tuple[bool, str]]]:
    """A page, and for each of its blocks whether it belongs to the main text, with the text."""
    rng = random.Random(seed)
    p = _Page(rng)
    p.out.append("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>")
    depth = rng.randint(0, 3)
    p.out += [p.open("div", WRAPPERS, 0.7) for _ in range(depth)]
    for kind, chance in (("notice", 0.3), ("header", 0.4), ("nav", 0.75), ("ad", 0.4), ("form", 0.15), ("sidebar", 0.2)):
        if rng.random() < chance:
            p.furniture(kind)
    if rng.random() < 0.97:
        p.article()
    order = [("form", 0.12), ("comments", 0.35), ("sidebar", 0.35), ("ad", 0.2), ("nav", 0.1), ("notice", 0.12)]
    rng.shuffle(order)
    for kind, chance in order:
        if rng.random() < chance:
            p.furniture(kind)
    closed = rng.randint(0, depth)
    p.out += ["</div>"] * closed
    if rng.random() < 0.75:
        p.furniture("footer")
    if rng.random() < 0.1:
        p.furniture("notice")
    p.out += ["</div>"] * (depth - closed) + (["</body></html>"] if rng.random() < 0.8 else [])
    return ("" if rng.random() < 0.7 else "\n").join(p.out), [(label, html.unescape(text)) for label, text in p.labels]
