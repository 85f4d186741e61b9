"""Labelled pages to learn from: layouts composed at random, in which the elements of the article's text are marked.

No table of labelled pages exists, so the classifier is fitted on a bounded number (a parameter) of these. What varies is
what varies between sites: which elements and names carry each part, where parts stand, how much text and how many links
they hold. Marked elements have the attribute MARK, which no feature reads.
"""

from __future__ import annotations

import random

MARK = "data-main"

#: Names that sites give to the parts of a page.
NAMES = {
    "header": "header masthead site-header page-header topbar top-bar branding logo banner-top hdr site-title tagline",
    "nav": "nav navbar navigation menu main-menu nav-menu nav-links breadcrumb breadcrumbs toc pagination pager subnav dropdown skip-links site-nav tabs toolbar",
    "notice": "cookie cookie-banner cookie-consent cookies gdpr consent notice alert popup modal overlay newsletter-popup paywall subscribe-banner announcement warning message toast disclaimer",
    "ad": "ad ads advert advertisement adsense ad-slot ad-container banner-ad sponsor sponsored sponsored-content promo promotion google-ads dfp outbrain taboola adbox commercial",
    "sidebar": "sidebar side-bar side rail right-rail widget widgets secondary related related-posts related-articles popular most-read recommended trending more-stories read-next tags tag-cloud archive categories",
    "share": "share sharing social social-links share-buttons follow share-bar addthis likes print",
    "comments": "comments comment comment-list comment-section respond responses discussion disqus disqus-thread replies reply reviews user-comments reader-comments feedback thread",
    "form": "form search search-form login signup subscribe subscription newsletter contact-form register poll survey",
    "footer": "footer site-footer page-footer bottom colophon copyright legal credits foot bottom-bar imprint",
    "author": "author author-bio about-author author-box bio profile",
    "article": "article post entry story content main main-content post-content entry-content article-body article-content article-text story-body post-body body-text text body hentry blog-post page-content copy prose news-article single-post",
    "neutral": "container wrapper wrap row col inner outer page site grid section block box layout column span left right center clearfix app root",
}
#: The same in German, French and Spanish.
FOREIGN_NAMES = {
    "header": "kopf kopfbereich seitenkopf entete en-tete bandeau cabecera encabezado",
    "nav": "navigation hauptnavigation menue hauptmenue brotkrumen seitennavigation fil-ariane menu-principal navegacion menu-superior migas",
    "notice": "hinweis cookie-hinweis datenschutzhinweis meldung avis bandeau-cookies avertissement aviso aviso-cookies mensaje",
    "ad": "anzeige werbung werbeblock publicite pub encart-pub publicidad anuncio patrocinado",
    "sidebar": "seitenleiste randspalte mehr-zum-thema verwandte-artikel meistgelesen colonne barre-laterale articles-lies a-lire-aussi barra-lateral relacionados mas-leidos",
    "share": "teilen partager reseaux-sociaux compartir redes-sociales",
    "comments": "kommentare kommentar leserkommentare diskussion commentaires commentaire reactions avis-lecteurs comentarios comentario opiniones",
    "form": "suche suchformular anmeldung formular recherche inscription formulaire connexion buscador formulario registro boletin",
    "footer": "fuss fusszeile seitenfuss impressum rechtliches pied-de-page pied mentions-legales pie pie-de-pagina aviso-legal creditos",
    "author": "autor autorenbox ueber-den-autor auteur a-propos-auteur sobre-el-autor",
    "article": "artikel beitrag inhalt hauptinhalt artikeltext beitragstext contenu texte corps-article contenu-principal articulo contenido noticia cuerpo texto-noticia",
    "neutral": "rahmen seite zeile spalte bereich kasten conteneur colonne bloc ligne contenedor fila columna bloque",
}
_OWN = {k: v.split() for k, v in NAMES.items()}
_ALL = {k: [*v, *FOREIGN_NAMES[k].split()] for k, v in _OWN.items()}
#: How the lines at the foot of pages begin, and what stands in menus, in four languages.
RIGHTS = ["Copyright", "&copy;", "(c)", "&copy; Copyright", "All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados."]
MENU = "Home News About Contact Imprint Privacy Terms Login Start Nachrichten Kontakt Impressum Datenschutz AGB Accueil Actualités Contact Mentions-légales Connexion Inicio Noticias Contacto Aviso-legal Privacidad".split()
_PARTS = "a an be co de el en er es est ing in ion is la le ly me ment na ne no o on or pa que ra re ri s se st ta te th ti to tion u un ver y".split()


class _Page:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng
        self.words = ["".join(rng.choices(_PARTS, k=rng.randint(1, 4))) for _ in range(150)]
        self.names = _OWN if rng.random() < 0.6 else _ALL
        self.plain = rng.random() < 0.12  # a page that hardly names or marks its parts

    def some(self, low: int, high: int) -> str:
        r = self.rng
        out = r.choices(self.words, k=r.randint(low, high))
        stop = 0
        for i in range(len(out)):
            if i >= stop:
                out[i] = out[i].capitalize()
                stop = i + r.randint(3, 18)
            if i + 1 == stop or i + 1 == len(out):
                out[i] += r.choice("...?!")
            elif r.random() < 0.08:
                out[i] += ","
        return " ".join(out)

    def few(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randint(low, high)))

    def named(self, part: str, tags: str, inside: str, bare: float = 0.15, marked: bool = False) -> str:
        r = self.rng
        tag = r.choice(tags.split())
        if self.plain and part != "comments" and tag not in ("td", "ul", "ol", "li"):
            tag = "div"
        own = tag in ("nav", "header", "footer", "aside", "article", "main", "form")
        hidden = self.plain and part in ("nav", "header", "footer", "article", "neutral") and r.random() < 0.8
        name = "" if hidden or r.random() < (0.5 if own else bare) else " ".join(r.sample(self.names[part], 1 + (r.random() < 0.25)))
        if name and r.random() < 0.3:
            name += " " + r.choice(self.names["neutral"])
        if name and r.random() < 0.15:
            name = name.replace("-", "_")
        at = "" if not name else f' {r.choice(["class", "class", "id"])}="{name}"'
        return f"<{tag}{at}{f' {MARK}' if marked else ''}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.rng
        n, kind = r.randint(low, high), r.random()
        menu = r.random() < 0.3
        one = lambda: f'<a href="/{self.few(1, 1)}">{r.choice(MENU) if menu else self.few(1, 5)}</a>'
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return r.choice([" | ", " ", "<br>"]).join(one() for _ in range(n)) if kind < 0.85 else "".join(f"<div>{one()}</div>" for _ in range(n))

    def teaser(self) -> str:
        r = self.rng
        return "".join(f"<{t}>{'<a href=x>' + self.few(3, 9) + '</a>' if r.random() < 0.7 else self.few(3, 9)}</{t}>" + (f"<p>{self.some(5, 25)}</p>" if r.random() < 0.4 else "") for t in [r.choice(["li", "h3", "h4", "div", "p"])] * r.randint(2, 6))

    def advert(self) -> str:
        text = self.some(2, 25)
        return self.named("ad", "div div div aside section ins", self.rng.choice([text, f"<p>{text}</p>", f"<a href=x>{text}</a>", f"<span>{self.few()}</span><p>{text}</p>"]), 0.0)

    def comment(self) -> str:
        r = self.rng
        body = f"<p>{self.some(3, 70)}</p>" * r.randint(1, 2)
        who = r.choice([f"<b>{self.few(1, 2)}</b>", f"<div class=author>{self.few(1, 2)}</div>", f"<h4>{self.few(1, 2)}</h4>", ""])
        return self.named("comments", "div li article section", who + body + (f"<a href=x>{self.few(1, 1)}</a>" if r.random() < 0.5 else ""), 0.4)

    def block(self, marked: bool = True) -> str:
        """A paragraph, or what else an article has."""
        r, y = self.rng, f" {MARK}" if marked else ""
        kind = r.random()
        long = (1, 12) if r.random() < 0.2 else (8, 140)
        if kind < 0.68:
            text = self.some(*long)
            if r.random() < 0.3:
                text = f"<{(t := r.choice(['b', 'em', 'a href=y', 'span', 'strong']))}>{self.few(1, 6)}</{t.split()[0]}> {text}"
            return f"<p{y}>{text}" + ("</p>" if r.random() < 0.9 else "<br>")
        if kind < 0.78:
            return f"<{(t := r.choice(['h2', 'h2', 'h3', 'h4']))}{y}>{self.few(1, 9)}</{t}>"
        if kind < 0.86:
            return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li{y}>{self.some(2, 25)}</li>" for _ in range(r.randint(2, 7))) + f"</{t}>"
        if kind < 0.91:
            return f"<blockquote{y}>{self.some(5, 50)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p{y}>{self.some(5, 50)}</p></blockquote>"
        if kind < 0.94:
            return f"<pre{y}>{self.few(4, 40)}</pre>"
        if kind < 0.97:
            return "<table>" + "".join("<tr>" + "".join(f"<td{y}>{self.few(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>"
        return f"<figure><img src=x><figcaption{y}>{self.some(3, 15)}</figcaption></figure>"

    def article(self) -> str:
        r = self.rng
        head = f"<{(t := r.choice(['h1', 'h1', 'h1', 'h2']))} {MARK}>{self.few(2, 14)}</{t}>"
        if r.random() < 0.25:
            head = f"<header>{head}</header>"
        style = r.random()
        if style < 0.75:
            blocks = [self.block() for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25]))]
        elif style < 0.88:
            blocks = [f"<div {MARK}>{self.some(10, 120)}</div>" for _ in range(r.randint(1, 10))]
        else:
            blocks = ["<div " + MARK + ">" + "<br><br>".join(self.some(10, 90) for _ in range(r.randint(1, 6))) + "</div>"]
        for make, chance in ((self.advert, 0.25), (self.share, 0.2), (lambda: self.named("sidebar", "div aside section", self.teaser(), 0), 0.15), (self.form, 0.1), (lambda: self.named("author", "div section aside", f"<p>{self.some(4, 40)}</p>", 0), 0.1)):
            if r.random() < chance:
                blocks.insert(r.choice([0, len(blocks), r.randint(0, len(blocks))]), make())
        inside = "".join(blocks)
        if r.random() < 0.4:
            inside = self.named("article", "div div section", inside, 0.3)
        inside = (head + inside) if r.random() < 0.92 else inside
        if r.random() < 0.12:
            inside += self.discussion()
        return self.named("article", "article article article div div section main td", inside, 0.3)

    def share(self) -> str:
        return self.named("share", "div ul section", self.links(2, 5), 0)

    def form(self) -> str:
        r = self.rng
        inside = f"<label>{self.few()}</label><input name=q>" * r.randint(1, 3) + (f"<p>{self.some(3, 20)}</p>" if r.random() < 0.6 else "") + f"<button>{self.few(1, 2)}</button>"
        return self.named("form", "form form form div", inside, 0)

    def discussion(self) -> str:
        title = f"<h3>{self.few(1, 4)}</h3>" if self.rng.random() < 0.7 else ""
        return self.named("comments", "div div section ol aside", title + "".join(self.comment() for _ in range(self.rng.randint(1, 8))) + (self.form() if self.rng.random() < 0.4 else ""), 0)

    def sidebar(self) -> str:
        r = self.rng
        inside = "".join(r.choice([self.teaser, lambda: self.links(3, 8), self.advert, self.form, lambda: f"<h3>{self.few()}</h3><p>{self.some(5, 40)}</p>"])() for _ in range(r.randint(1, 3)))
        return self.named("sidebar", "aside aside div div section", inside, 0)

    def table(self, main: str) -> str:
        """A layout of table rows and cells: a head, a menu beside the article, a foot."""
        r = self.rng
        cell = lambda x: f"<td{r.choice(['', '', ' valign=top', ' width=160', ' bgcolor=#eeeeee'])}>{x}</td>"
        menu = r.choice([" ", "<br>", " | "]).join(f"<a href=x>{r.choice(MENU) if r.random() < 0.5 else self.few(1, 3)}</a>" for _ in range(r.randint(2, 10)))
        rows = [cell(menu) + cell(main) if r.random() < 0.6 else cell(main) + cell(menu)]
        if r.random() < 0.5:
            rows[0] += cell(r.choice([self.teaser, self.advert])())
        if r.random() < 0.6:
            rows.insert(0, cell(self.few(1, 4)))
        if r.random() < 0.7:
            rows.append(cell(f"{r.choice(RIGHTS)} {r.randint(1998, 2026)} {self.few(0, 4)}"))
        return "<table>" + "".join(f"<tr>{x}</tr>" for x in rows) + "</table>"

    def whole(self) -> str:
        r = self.rng
        main = self.article()
        if r.random() < 0.3:
            main = r.choice([f"<main>{main}</main>", self.named("neutral", "div section", main), f'<div id="main">{main}</div>'])
        parts = [main]
        if r.random() < 0.75:
            parts.insert(0, self.named("nav", "nav nav nav div ul", self.links(3, 12), 0))
        if r.random() < 0.5:
            inside = f"<h1>{self.few(1, 4)}</h1>" * (r.random() < 0.4) + f"<p>{self.few(2, 8)}</p>" * (r.random() < 0.5) + (self.links(3, 9) if r.random() < 0.5 else f"<a href=/>{self.few(1, 3)}</a>")
            parts.insert(0, self.named("header", "header header div div", inside, 0))
        for make, chance, before in ((self.advert, 0.45, 0.6), (self.sidebar, 0.5, 0.35), (self.discussion, 0.35, 0), (lambda: self.named("notice", "div div section aside", f"<p>{self.some(4, 45)}</p>" if r.random() < 0.6 else self.some(4, 45), 0), 0.35, 0.6), (self.form, 0.2, 0.4), (self.share, 0.15, 0.3)):
            if r.random() < chance:
                i = parts.index(main)
                parts.insert(r.randint(0, i) if r.random() < before else r.randint(i + 1, len(parts)), make())
        if r.random() < 0.8:
            rights = f"{r.choice(RIGHTS)} {r.choice(['', str(r.randint(1998, 2026))])} {self.few(0, 4)}"
            inside = r.choice([f"<p>{self.some(3, 25)}</p>", self.some(3, 25), rights, f"<p>{rights}</p>", f"&copy; {self.few(1, 3)} {self.some(2, 15)}", self.links(2, 9), self.links(2, 6) + f"<p>{self.some(2, 30)}</p>"])
            parts.append(self.named("footer", "footer footer footer div", inside, 0))
        body = "".join(parts)
        if self.plain and r.random() < 0.5:
            body = self.table(main)
        if r.random() < 0.3:
            body = self.named("neutral", "div", body, 0)
        if r.random() < 0.03:
            body = f"<form id=aspnet>{body}</form>"
        return f"<!DOCTYPE html><html><head><title>{self.few()}</title></head><body>{body}</body></html>"


def sample(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).whole() for _ in range(n)]
