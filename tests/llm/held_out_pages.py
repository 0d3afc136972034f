"""Page layouts that no labelled page has, with the main text marked, to measure how extraction generalises."""

A = "The harbour was quiet when the first boats came in, and nobody on the pier spoke of the storm that had kept them out for two days."
B = "Engineers had warned for years that the old sluice would give way, but the repair was put off each spring."
C = "By noon the market had filled with people from the villages, who stayed until the lamps were lit along the quay."
S, T = "Read more", "Two words"
_ = '<a href="/x">Home</a>'

PAGES = [
    # a blog theme with wrappers
    f'<div id="page" class="hfeed site"><div id="masthead" class="site-header"><p>My blog</p>{_}</div><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-7" class="post type-post"><div class="entry-header">[[<h1 class="entry-title">{T}</h1>]]</div><div class="entry-content">[[<p>{A}</p><p>{B} <em>{T}</em></p><h2>{T}</h2><p>{C}</p>]]</div></article><div id="comments" class="comments-area"><p>{B}</p><p>{A}</p></div></main></div><div id="secondary" class="widget-area sidebar"><div class="widget"><h3>{T}</h3><ul><li>{_}</li><li>{_}</li></ul></div></div><div id="colophon" class="site-footer"><p>All rights reserved</p></div></div>',
    # documentation with a tree of links at the side
    f'<body><nav class="docs-nav"><ul><li>{_}<ul><li>{_}</li><li>{_}</li></ul></li></ul></nav><main role="main"><div class="document"><div class="body">[[<h1>{T}</h1><p>{A}</p><pre><code>x = 1\ny = 2</code></pre><p>{B}</p><ul><li><p>{C}</p></li><li><p>{T}</p></li></ul>]]</div></div></main><footer><p>Built with a tool</p>{_}</footer></body>',
    # news page with an advert between paragraphs and related links
    f'<header><div class="topbar">{_}{_}</div></header><section class="story"><h1>[[{T}]]</h1><div class="story-text">[[<p>{A}</p>]]<div class="advert"><p>{B}</p></div>[[<p>{C}</p><p>{B}</p>]]</div></section><section class="recommended"><h3>{T}</h3><ul><li><a href="/1">{A}</a></li><li><a href="/2">{B}</a></li></ul></section><footer>{_}{_}</footer>',
    # table layout of old
    f'<table><tr><td class="menu">{_}<br>{_}<br>{_}</td><td class="content">[[<h2>{T}</h2><p>{A}<p>{B}<p>{C}]]</td></tr></table><div class="footer">{_} {T}</div>',
    # an article with figure, quote and a definition list
    f'<main><article>[[<h1>{T}</h1><figure><img src=x><figcaption>{T}</figcaption></figure><p>{A}</p><blockquote><p>{B}</p></blockquote><dl><dt>{T}</dt><dd>{C}</dd></dl>]]<aside class="newsletter"><p>{B}</p><form><input><button>Go</button></form></aside></article></main><footer><small>{T}</small></footer>',
    # a list of links as the main text
    f'<nav>{_}{_}</nav><article>[[<h1>{T}</h1><p>{A}</p><ol><li><a href="/a">{B}</a></li><li><a href="/b">{C}</a></li><li>{T}</li></ol><p>{C}</p>]]</article><div class="cookie-banner">{A}<button>OK</button></div>',
    # nested sections, notice on top
    f'<div class="alert notice"><p>{T}, {B}</p></div><header>{_}</header><main><section>[[<h2>{T}</h2><p>{A}</p>]]</section><section>[[<h2>{T}</h2><p>{B}</p><p>{C}</p>]]</section></main><aside><p>{A}</p></aside><footer>{T}</footer>',
    # spans and line breaks
    f'<div class="navigation">{_} {_}</div><div class="post-body">[[<span>{A}</span><br><br><span>{B}</span><br>{C}]]</div><div class="social">{_}{_}</div><div class="replies"><div>{B}</div><div>{T}</div></div>',
]

NEXT = '<a href="/y">Older</a>'
LINKS = "<ul><li><a>First reference work</a></li><li><a>Second one</a></li><li><a>Third one</a></li></ul>"

#: Pages whose class words no labelled page has, so that structure alone speaks, and reference lists.
UNSEEN_NAMES = [
    f'<div class="rail-left"><p>{T}</p>{_}{NEXT}</div><article class="kern">[[<h1>{T}</h1><p>{A}</p><p>{B}</p>]]</article><div class="talkback"><p>{C}</p><p>{B}</p></div><div class="colophon"><p>{T}</p></div>',
    f'<div class="zone-1">{_}{NEXT}{_}</div><main class="zone-2">[[<h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p>]]</main><div class="zone-3"><p>{B}</p></div>',
    f'<header class="x1">{_}</header><div class="x2"><p>{B}</p></div><article>[[<h2>{T}</h2><p>{A}</p>{LINKS}<p>{C}</p>]]</article><footer class="x9">{T}</footer>',
    f'<nav>{_}{NEXT}</nav><main>[[<h1>{T}</h1><p>{A}</p><p>{B}</p>{LINKS}]]</main><div class="discussion"><p>{B}</p><p>{C}</p></div>',
    f'<nav>{_}{NEXT}</nav><article>[[<h1>{T}</h1><p>{A}</p><h2>{T}</h2>{LINKS}]]</article><aside class="u7"><ul><li>{_}</li><li>{NEXT}</li></ul></aside>',
    f'<div class="qz"><ul><li>{_}</li><li>{NEXT}</li><li>{_}</li></ul></div><div class="wv">[[<h1>{T}</h1><p>{A}</p><p>{B}</p><p>{C}</p>]]</div><div class="yk">{_} {NEXT}</div>',
]
