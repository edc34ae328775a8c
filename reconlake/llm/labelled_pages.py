"""Pages labelled by hand, from which the extraction weights are learned.

Elements with the attribute data-main hold main text; all else is not. The
layouts are invented; they use the element and class names that are common on
public sites, since those names are what is learned: names of boilerplate on
blocks beside the text, and the same words inside names of blocks around it.
"""

_W = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua"
_L = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul>"

#: Names that mark boilerplate when they are a class, an id or a role.
_OUTSIDE = (
    "nav navigation navbar menu topbar masthead header footer colophon sidebar aside rail widget related recommended "
    "ad ads advert advertisement adsense sponsored sponsor promo promotion banner popup modal overlay newsletter subscribe signup "
    "cookie cookies consent gdpr notice alert comments comment comment-list respond replies disqus share sharing social breadcrumb breadcrumbs "
    "pagination pager toc login search form copyright legal hidden skip "
    # German, French and Spanish
    "navigationsleiste seitenleiste menue kopfzeile fusszeile fussbereich impressum kommentar kommentare werbung anzeige anzeigen hinweis teilen suche suchformular anmelden verwandte "
    "barre-laterale entete en-tete pied pied-de-page commentaire commentaires publicite pub partager partage recherche connexion abonnement avis mentions-legales articles-lies "
    "barra-lateral cabecera encabezado pie pie-de-pagina comentario comentarios publicidad anuncio anuncios compartir buscar busqueda buscador aviso aviso-legal suscripcion relacionados"
).split()
#: Names that mark the main text.
_INSIDE = "article main content post entry story body text prose".split()
#: Names of blocks of main text, or around it, that hold a word of _OUTSIDE.
_AROUND = "has-sidebar no-sidebar with-sidebar comments-open post-header entry-header article-header page-header post-meta".split()
#: What such a word is compounded with beside the text.
_WITH = "site page left right top main".split()
_TAGS_OUTSIDE = "nav footer header aside form button select option label fieldset noscript iframe menu dialog template svg".split()

LABELLED_PAGES = (
    [
        f"<html><head><title>{_W}</title><style>p{{margin:0}}</style><script>var a = 1;</script></head><body>"
        f"<{t}>{_L} {_W}</{t}><article><h1 data-main>Lorem ipsum</h1><p data-main>{_W}</p><p data-main>{_W} <a href=/x>{_W}</a></p></article>"
        f"<{t}>{_W}</{t}></body></html>"
        for t in _TAGS_OUTSIDE
    ]
    + [
        f"<html><body><div class='{c}'>{_L}<p>{_W}</p></div><div class={i}><h2 data-main>Lorem</h2><p data-main>{_W}<br>{_W}</p>"
        f"<blockquote data-main>{_W}</blockquote><ul><li data-main>{_W}</li><li data-main>{_W}</li></ul></div><div id={c}><span>{_W}</span></div>"
        + "".join(f"<div class='{x}-{c} {c}-box'>{_W}</div>" for x in _WITH)
        + "</body></html>"
        for c in _OUTSIDE
        for i in _INSIDE
    ]
    + [
        f"<html><body><main><div class='{c}'><p>{_W}</p></div><section><h1 data-main>Lorem</h1><div data-main>{_W}</div>"
        f"<table><tr><td data-main>{_W}</td></tr></table><pre data-main>{_W}</pre></section></main><section class={c}>{_W}</section></body></html>"
        for c in _OUTSIDE
    ]
    + [
        f"<html><body><div class=nav>{_L}</div><div class={c} data-main><h1>Lorem</h1></div><div class='{i} {i}-box {" ".join(f"{x}-{i}" for x in _WITH)}' data-main><div class={c}><p>{_W}</p></div>"
        f"<section>{f'<p>{_W}</p>' * 12}</section><ul><li>{_W}</li></ul><table><tr><td>{_W}</td></tr></table></div></body></html>"
        for c in _AROUND
        for i in _INSIDE
    ]
)
