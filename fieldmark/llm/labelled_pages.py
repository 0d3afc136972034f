"""Labelled pages that the extraction model is trained on, made by rule from page layouts.

``[[`` and ``]]`` enclose main text in a layout; ``{t}`` is a paragraph's text,
``{s}`` a short one and ``{u}`` a link. The text itself carries no signal. A word
in braces, such as ``{menu}``, stands for the names that pages give such a part;
what each name means is learned from the pages, nothing else knows these lists.
"""

from __future__ import annotations

MAIN_OPEN, MAIN_CLOSE = "<!--main-->", "<!--/main-->"

#: Words that class, id and role attributes use, by the part of a page that bears them.
NAMES = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs pagination pager".split(),
    "head": "header masthead banner topbar".split(),
    "foot": "footer legal copyright contentinfo tags".split(),
    "side": "sidebar aside widget complementary sidecolumn".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay".split(),
    "ask": "form newsletter subscribe signup login search".split(),
    "comments": "comments comment replies reply disqus responses".split(),
    "share": "share social sharing follow".split(),
    "related": "related recommended more trending".split(),
    "main": "article content post entry body main story text".split(),
}

TITLE_TOP = "<header><h1>{s}</h1><p>{s}</p></header>"
NAMED_TOP = '<div id="{head}"><h2>{s}</h2><p>{s}</p></div>'
NAV = '<nav><ul><li><a href="{u}">{s}</a></li><li><a href="{u}">{s}</a></li><li><a href="{u}">{s}</a></li></ul></nav>'
MENU = '<div class="{menu}"><a href="{u}">{s}</a> <a href="{u}">{s}</a> <a href="{u}">{s}</a></div>'
MENU_LIST = '<ul class="{menu}"><li><a href="{u}">{s}</a></li><li><a href="{u}">{s}</a></li></ul>'
TOP = '<header class="site-{head}"><a href="/">{s}</a><p>{s}</p></header>'
FOOT = "<footer>&copy; {s} &middot; {t}</footer>"
FOOT_LINKS = '<div id="{foot}"><p>{s}</p><a href="{u}">{s}</a><a href="{u}">{s}</a></div>'
SIDE = '<aside><h3>{s}</h3><ul><li><a href="{u}">{s}</a></li><li><a href="{u}">{s}</a></li></ul></aside>'
SIDE_TEXT = '<div class="{side}"><h4>{s}</h4><p>{t}</p><a href="{u}">{s}</a></div>'
AD = '<div class="{ad}">{t}</div>'
PROMO = '<section class="{ad} banner"><p>{t}</p><a href="{u}">{s}</a></section>'
NOTICE = '<div class="{notice}" role="alert"><p>{t}</p><button>{s}</button></div>'
FORM = '<form action="/join"><label>{s}</label><p>{t}</p><input name="q"><select><option>{s}</option></select><button>{s}</button></form>'
ASK = '<div class="{ask}"><p>{s}</p><p>{t}</p><input name="q"><button>{s}</button></div>'
COMMENTS = '<section class="{comments}"><h3>{s}</h3><div class="comment"><b>{s}</b><p>{t}</p></div><div class="comment"><p>{t}</p></div><p>{t}</p></section>'
COMMENT_LIST = '<ol id="{comments}"><li><p>{t}</p></li><li><p>{t}</p><p>{t}</p></li></ol>'
COMMENT_ARTICLES = '<section id="{comments}"><h2>{s}</h2><article class="comment"><p>{t}</p></article><article class="comment"><p>{t}</p><p>{t}</p></article></section>'
ROLES = '<div role="complementary"><p>{t}</p></div><div role="contentinfo"><p>{s}</p></div>'
COMMENT_DIVS = '<div class="{comments}"><p>{s}</p><p>{t}</p><div>{s}</div></div>'
ONE_COMMENT = '<div class="{comments}"><p>{s}</p></div>'
SHARE = '<div class="{share}"><a href="{u}">{s}</a><a href="{u}">{s}</a></div>'
RELATED = '<div class="{related}"><h4>{s}</h4><ul><li><a href="{u}">{t}</a></li><li><a href="{u}">{t}</a></li></ul></div>'
LINKED = '[[<h1>{s}</h1><ul><li><a href="{u}">{t}</a></li><li><a href="{u}">{s}</a></li><li>{s}</li></ul><p>{t}</p><ol><li><a href="{u}">{s}</a> {t}</li><li>{t}</li></ol><p>{t}</p>]]'
ITEM = '<li><a href="{u}">{s}</a></li>'
WORDED = '<li><a href="{u}">{s} {s}</a></li>'
LISTED = f"[[<h1>{{s}}</h1><p>{{t}}</p><ul>{ITEM * 3}</ul><p>{{t}}</p>]]"
REFERENCES = f"[[<h1>{{s}}</h1><p>{{t}}</p><p>{{t}}</p><h2>{{s}}</h2><ol>{WORDED * 4}</ol>]]"
FEW_LINKS = f'[[<h1>{{s}}</h1><p>{{t}}</p><ul>{WORDED}{ITEM}</ul><h2>{{s}}</h2><p>{{t}}</p><ul>{ITEM}<li>{{s}}</li>{WORDED}</ul>]]'
MANY_LINKS = f"[[<h1>{{s}}</h1><ul>{ITEM * 8}</ul><p>{{t}}</p><ul>{WORDED * 5}</ul>]]"
UNSEEN = '<div hidden><p>{t}</p></div><p style="display:none">{t}</p><span aria-hidden="true">{s}</span>'
PLAIN = "<div><div><p>{t}</p><p>{s}</p></div></div>"
SECTIONS = '[[<h1>{s}</h1><section><h2>{s}</h2><p>{t}</p><pre>{t}</pre></section><section><h2>{s}</h2><p>{t}</p><dl><dt>{s}</dt><dd>{t}</dd></dl></section>]]'
BODY = "[[<h1>{s}</h1><p>{t}</p><p>{t} <b>{s}</b> {t}</p><p>{s}</p><p>{t}</p>]]"
RICH = '[[<h1>{s}</h1><p>{t}</p><h2>{s}</h2><p>{t} <a href="{u}">{s}</a> {t}</p><h3>{s}</h3><p>{t}</p><ul><li>{s}</li><li>{t}</li></ul><blockquote><p>{t}</p></blockquote><table><tr><th>{s}</th><td>{s}</td></tr></table><pre><code>{s}</code></pre><figure><figcaption>{s}</figcaption></figure>]]'
SHORT = "[[<h1>{s}</h1><p>{s}</p>]]"
DIVS = '[[<div class="body"><div>{t}</div><div>{t}<br>{t}</div><span>{s}</span></div>]]'

LAYOUTS = [
    NAV + AD + f"<article>{BODY}</article>" + FOOT,
    NAV + AD + f"<article>{SHORT}</article>" + FOOT,
    NAV + f"<article>[[<h1>{{t}}</h1><p><b>{{t}}</b></p><p>{{t}}</p>]]</article>" + FOOT,
    NAV + AD + "<article>[[<h1>{s}</h1><p><b>{s}<br>{t}<p>{t}</p>]]</article>" + FOOT,
    TOP + NAV + f"<main><article>{RICH}{AD}{SHARE}</article>{COMMENTS}</main>" + SIDE + FOOT,
    NOTICE + TOP + MENU + f'<div class="{{main}}">{RICH}</div>' + SIDE_TEXT + FOOT_LINKS,
    TOP + f'<div id="{{main}}">{DIVS}{RELATED}</div>' + SIDE + FORM + FOOT,
    NAV + f"<article>{BODY}{COMMENTS}</article>" + SIDE_TEXT + FOOT_LINKS,
    MENU + f'<div class="{{main}}">{BODY}{SHARE}{RELATED}</div>' + COMMENT_LIST + FOOT,
    NOTICE + NAV + f"<main>{RICH}{PROMO}{FORM}</main>" + FOOT_LINKS,
    f"<body>{BODY}</body>",
    TOP + f'<section class="{{main}}-body">{DIVS}</section>' + AD + FORM + COMMENTS + FOOT,
    NAV + f"<article><header>[[<h1>{{s}}</h1>]]</header>{AD}[[<p>{{t}}</p><p>{{t}}</p>]]<footer>{{s}}</footer></article>" + FOOT,
    TITLE_TOP + NAV + f"<main><article>{BODY}</article></main>" + COMMENT_ARTICLES + SIDE_TEXT + FOOT,
    NAMED_TOP + MENU + f'<div class="wrap">{SIDE_TEXT}<div class="{{main}}">{RICH}</div></div>' + FOOT_LINKS,
    TITLE_TOP + f"<article>{RICH}</article>" + COMMENT_ARTICLES + FOOT,
    '<div role="banner">{s}</div>' + f'<div role="main">{BODY}</div>' + ROLES,
    NAMED_TOP + f"<article>{BODY}</article>" + FORM + ROLES + COMMENTS,
    TOP + "<main><article>[[<h1>{s}</h1><p>{t}</p>]]<aside><h3>{s}</h3><p>{t}</p></aside>[[<p>{t}</p><p>{t}</p>]]<aside><p>{t}</p></aside></article></main>" + FOOT,
    f"<article>{SHORT}{COMMENT_DIVS}</article>",
    NAV + f"<article>[[<p>{{s}}</p>]]{AD}{COMMENT_DIVS}</article>" + FOOT,
    TOP + NAV + f"<main>{LINKED}</main>" + SIDE + FOOT,
    NAV + f'<article class="{{main}}">{LINKED}{ASK}</article>' + FOOT_LINKS,
    MENU_LIST + f'<div class="{{main}}">{SECTIONS}{RELATED}</div>' + ASK + FOOT,
    NAMED_TOP + MENU_LIST + f'<div id="{{main}}"><div class="{{main}}">{BODY}</div>{COMMENTS}</div>' + FOOT,
    NAV + f"<article>{LISTED}</article>" + FOOT,
    TOP + NAV + f"<main>{REFERENCES}</main>" + SIDE + FOOT,
    NAV + f"<article>{REFERENCES}</article>" + COMMENT_LIST + FOOT_LINKS,
    MENU + f"<main><article>{FEW_LINKS}{SHARE}</article></main>" + SIDE + FOOT,
    NAMED_TOP + MENU_LIST + f'<div class="{{main}}">{LISTED}{RELATED}</div>' + FOOT,
    TOP + NAV + f'<div id="{{main}}">{FEW_LINKS}</div>' + SIDE_TEXT + FOOT_LINKS,
    NAV + f"<main>{MANY_LINKS}</main>" + FOOT,
    NAV + f"<article>{MANY_LINKS}</article>" + SIDE + FOOT,
    f"<article>[[<p>{{s}}</p>]]{ONE_COMMENT}</article>",
    NAV + f"<main><article>{BODY}{ONE_COMMENT}</article></main>" + FOOT,
    NAV + f"<article>{SHORT}{FORM}{SIDE_TEXT}{COMMENTS}</article>" + FOOT,
    "<article><div><div><div>[[<p>{s}</p>]]</div></div></div></article>",
    NAV + f"<article><div>{BODY}</div></article>" + FOOT,
    TOP + f"<main><div><div><article><div>{RICH}</div></article></div></div></main>" + SIDE + FOOT,
    UNSEEN + NAV + f"<article>{UNSEEN}{BODY}{UNSEEN}</article>" + FOOT,
    PLAIN + NAV + f"<article>{BODY}</article>" + PLAIN + FOOT,
    TOP + PLAIN + f"<main>{RICH}</main>" + PLAIN + FOOT_LINKS,
    PROMO + f"<main><section>{BODY}</section><section>[[<h2>{{s}}</h2><p>{{t}}</p>]]</section></main>" + SIDE + FOOT_LINKS,
]
#: Pages without the usual frame.
BARE = ["[[{t}]]", "[[<p>{t}</p><p>{s}</p>]]", f"<article>{SHORT}{COMMENT_DIVS}</article>", NAV + f"<article>{BODY}</article>" + FOOT]


def pages() -> list[str]:
    """Every layout with short, middling and long texts, and each time the next of the names of its parts."""
    out, turns = [], max(map(len, NAMES.values()))
    for turn, words in ((i, n) for i in range(turns) for n in (6, 30, 120)):
        names = {k: v[turn % len(v)] for k, v in NAMES.items()}
        filling = {"t": " ".join(["word"] * words), "s": "two words", "u": "/place"} | names
        for layout in LAYOUTS + BARE:
            marked = layout.replace("[[", MAIN_OPEN).replace("]]", MAIN_CLOSE)
            for key, value in filling.items():
                marked = marked.replace("{" + key + "}", value)
            out.append(marked if layout in BARE else f"<html><head><title>two words</title></head><body>{marked}</body></html>")
    return out
