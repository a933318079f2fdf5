"""Pages whose article lies in forms or several boxes, and discussions told by structure."""

import pytest

from surtido.llm.html_extraction import main_text

# Invented prose
P = ["Shipping costs rose for a third month, the port said, as storms kept vessels waiting outside.",
     "Officials expect the backlog to clear by spring, although carriers, insurers and farmers are less sure of it.",
     "In the meantime, warehouses along the river are full, and trucks queue for hours at the gates each day.",
     "The harbour master, who took office in May, wants longer shifts and a second crane before the winter.",
     "Nobody was hurt in the storms, but two small ferries stay in dock until repairs end, a spokesman said."]


def p(*at):
    return "".join(f"<p>{P[i]}</p>" for i in at)


def posts(n, form):
    return "".join(form.format(i=i, text=P[i % 5], more=P[(i + 1) % 5]) for i in range(n))


POST = "<div class=msg><span class=user>Bob{i}</span> <span class=date>2024-01-0{i}</span><p>{text}</p><p>{more}</p><a href=#>Reply</a></div>"
SHORT_POST = "<div class=m><b>Bob{i}</b> <time>10:3{i}</time><p>{text}</p><button>Reply</button> <a href=#>Report</a></div>"
LI_POST = "<li><img class=avatar><i class=nick>Bob{i}</i><em>hace {i}</em><blockquote>{text}</blockquote></li>"
LINKS = "<ul>" + "".join(f"<li><a href=x>{t}</a></li>" for t in P) + "</ul>"


@pytest.mark.parametrize("body, want", [
    (f"<form id=aspnetForm action=x><div>{p(0, 1, 2)}</div></form>", P[:3]),
    (f"<form><div class=nav><a href=a>Home</a></div><div id=main><h1>Title here</h1>{p(0, 1, 2)}<input name=x>"
     "<label>Your mail address please, now</label></div></form>", ["Title here", *P[:3]]),
    (f"<fieldset><article>{p(0, 1)}</article></fieldset>", P[:2]),
    (f"<div id=c>{p(0, 1, 2)}</div><form><p>{P[4]}</p><input></form>", P[:3]),
    (f"<div id=wrap><section>{p(0, 1, 2)}</section><section>{p(3, 4)}</section></div>", P),
    (f"<div class=page><div class=intro>{p(0)}</div><div class=copy>{p(1, 2, 3, 1, 2, 3)}</div><div class=outro>{p(4)}</div></div>",
     [P[0], *P[1:4], *P[1:4], P[4]]),
    (f"<div class=a>{p(0, 1)}</div><div class=b>{p(2, 3)}</div>{LINKS}", P[:4]),
    (f"<div class=title><h1>The title</h1></div><div class=content>{p(0, 1, 2)}</div>", ["The title", *P[:3]]),
    (f"<div><div class=hero><h1>The title</h1></div></div><div><div class=content>{p(0, 1)}</div></div>", ["The title", *P[:2]]),
    (f"<div><h1><a href=/>The site</a></h1></div><div class=content>{p(0, 1, 2)}</div>", P[:3]),
    (f"<div role=dialog>{p(4)}</div><div>{p(0, 1, 2)}</div>", P[:3]),
    (f"<h1>Story</h1><div class=story>{p(0, 1)}</div><div class=discussion>{posts(5, POST)}</div>", ["Story", *P[:2]]),
    (f"<div class=story>{p(0, 1)}</div>{posts(4, SHORT_POST)}", P[:2]),
    (f"<article>{p(0, 1)}<ol>{posts(3, LI_POST)}</ol></article>", P[:2]),
])
def test_no_article_text_is_lost_and_nothing_else_stays(body, want):
    assert main_text(f"<html><head><title>x</title></head><body>{body}</body></html>") == "\n".join(want)


def test_a_page_that_is_a_discussion_keeps_its_posts():
    text = main_text(f"<body><div>{posts(4, SHORT_POST)}</div></body>")
    assert all(t in text for t in P[:4])


def test_items_without_two_marks_are_no_posts():
    lists = "".join(f"<li><b>Point {i}</b>{t}</li>" for i, t in enumerate(P))
    text = main_text(f"<body><div>{p(0)}<ul>{lists}</ul></div></body>")
    assert all(t in text for t in P)
