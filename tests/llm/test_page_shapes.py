"""Operator 1 on pages as theme-driven sites write them, set by hand, and on malformed pages of any length."""

import time

import pytest

from spanfold.llm import html_text

LINE = "These words are what a reader came for, and there are enough of them to fill a line or two of text."
ARTICLE = f"<h1>Big news today</h1><p>{LINE}</p><p>{LINE} {LINE}</p><h2>More of it</h2><p>{LINE}</p>"
TEXT = "\n".join(["Big news today", LINE, f"{LINE} {LINE}", "More of it", LINE])
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav>"
FOOT = "<footer><p>Copyright us 2020</p></footer>"
SIDE = f"<aside class=sidebar><p>{LINE}</p></aside>"
COMMENTS = f"<section id='comments'><article class='comment'><p>{LINE}</p></article><article class='comment'><p>I agree.</p></article></section>"


@pytest.fixture(scope="module")
def chain():
    return html_text.train()


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='page has-sidebar sidebar-right'>{NAV}<article>{ARTICLE}</article>{FOOT}",
        f"<body class='nav-fixed menu-open'>{NAV}<main>{ARTICLE}</main>{FOOT}",
        f"<html class='no-js ads-on'><body>{NAV}<article class='post-12 post type-post tag-newsletter category-popular'>{ARTICLE}</article>{FOOT}",
        f"<body><form id='aspnetForm'>{NAV}<article>{ARTICLE}</article>{FOOT}</form>",
        f"<body><form id='aspnetForm'>{NAV}<div class='content'>{ARTICLE}</div>{FOOT}</form>",
        f"<body><div class='content-sidebar-wrap'>{NAV}<main>{ARTICLE}</main>{SIDE}</div>{FOOT}",
        f"<body><form id='f1'><main>{ARTICLE}</main></form>{FOOT}",
        f"<body><header class='site-header'><a href=/>Site</a></header><div class='l-sidebar-left'><main role='main'><article class='entry comments-open'>{ARTICLE}</article></main></div>{SIDE}{COMMENTS}{FOOT}",
        f"<body><div id='page-menu-wrapper'>{NAV}<table class='layout'><tr><td>{ARTICLE}</td></tr></table></div>{FOOT}",
    ],
)
def test_names_of_what_holds_the_page_do_not_decide(chain, page):
    assert html_text.main_text(page, chain) == TEXT


def test_parts_of_an_article_are_still_told_apart(chain):
    page = f"<body><article class='post'>{ARTICLE}<div class='share-buttons'><a href=/s>Share</a></div><form class='newsletter'><label>Mail</label><input></form>{COMMENTS}</article>"
    assert html_text.main_text(page, chain) == TEXT


N = 100_000


@pytest.mark.parametrize(
    "page",
    ["<a" * N, '<p title="x ' * N, '<p title="x ' * (N + 1) + ">", '<a ">"x' * N + "'>", "<![CDATA[>" * N, "<!--" * N, "<!-->" * N, "<" * N, "<annotation>" * 50_000, "<style>" * 50_000]
    + ["<div><span>x" * 50_000 + "</ul>" * 50_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<p><b>" * 50_000, "<table><tr><td>x" * 30_000]
    + ["".join(f"<div class='{'x' * (k % 300)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}'>t" for k in range(20_000))],
)
def test_malformed_pages_take_linear_time(page):
    began = time.time()
    html_text.blocks(page)
    assert time.time() - began < 2


def test_scanner_on_odd_markup():
    def texts(page):
        return [t for t, _ in html_text.blocks(page)]

    assert texts('a <p title="x>y">b<p title=\'"\'>c') == ["a", "b", "c"]
    assert texts('<p title="x>b') == ["b"]  # the quote never ends
    assert texts("a < b <3 <p>c") == ["a < b <3", "c"]
    assert texts("a<!-- <p>no</p> -->b<!-- no") == ["ab"]
    assert texts("<![CDATA[a <b> c]]>d<![CDATA[e>f") == ["a <b> cdf"]
    assert texts("a<?php x ?>b<!DOCTYPE html>c</unknown>d<a") == ["abcd<a"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><dl><dt>e<dd>f<dt>g</dl>") == list("abcdefg")
    assert texts("<table><tr><td>a<td>b<tr><td><p>c<p>d</table>") == list("abcd")
