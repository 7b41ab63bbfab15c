"""Labels for fitting the block labeller of problem 1: what a person would mark on sample pages.

Only ``fit`` in ``boilerplate`` uses them, on a bounded sample; the labels of the query come from the
fitted network alone. A line is labelled by the words of its own kind of site furniture in seven
languages and, for teaser boxes, by the run of lines under the box's heading.
"""

from __future__ import annotations

import regex

#: Words of navigation menus.
MENU = {
    w for ws in (
        "home|pricing|docs|contact|about|sign in|help center|support|status|blog|press|careers|partners|markets|menu|search|log in|news|faq|products|sitemap|help|shop|account",
        "首頁|價格|市場|文件|客服中心|聯絡我們|關於我們|登入|徵才|最新消息|新聞稿|合作夥伴|選單|網站導覽|常見問題",
        "ホーム|料金|市場|ドキュメント|ヘルプ|お問い合わせ|会社概要|ログイン|採用情報|お知らせ|報道|パートナー|メニュー|サイトマップ",
        "startseite|preise|märkte|dokumentation|hilfe|kontakt|über uns|anmelden|karriere|aktuelles|presse|partner|menü|barrierefreiheit|übersicht|suche",
        "accueil|tarifs|marchés|documentation|aide|contact|à propos|connexion|emplois|actualités|presse|partenaires|recherche",
        "inicio|precios|mercados|documentación|ayuda|contacto|quiénes somos|entrar|empleo|noticias|prensa|socios|buscar",
        "início|preços|mercados|documentação|ajuda|contato|sobre nós|entrar|carreiras|notícias|imprensa|parceiros",
    ) for w in ws.split("|")
}
#: Notices, tools and footers of a site.
FURNITURE = regex.compile("|".join((
    r"^:::$", r"^©", r"^Skip to|^Jump to content|^Toggle navigation|^Search this site|^Back to top|^Load more|^Share this page|^Print \||^Listen to this page|^Page \d+ of \d+",
    r"^Accept cookies|^We use cookies|^This website stores|^Cookies help us|choose which cookies|^By continuing|^Manage (?:cookie|preferences)",
    r"^Sign up for our newsletter|^Enjoying this article|^Enter your e-mail|^Subscribe|^Advertisement$|^Sponsored content|^Story continues below",
    r"^Some functions of this site need|^Follow us\b|^(?:Rechercher|Suchen|Buscar|Search)$|^Síganos|^Folgen Sie uns|^Suivez-nous|^追蹤我們|^フォロー|^Legal notice|^Terms of use|^Powered by|is a trading name of|^Best viewed|^« ?(?:Previous|Zurück|Précédent|Anterior)|^Read also:|^Related:",
    r"^跳到|^開啟選單|^站內搜尋|^回頁首|^載入更多|^分享本頁|^友善列印|^上一頁|^收聽|^聽本頁|^朗讀|^第 ?\d+ ?頁|^本網站使用 ?Cookie|^管理 ?Cookie|^繼續瀏覽.*同意|^接受 ?Cookie|^訂閱電子報|^請輸入電子郵件|^喜歡這篇|^廣告|^贊助內容|^本網站部分功能",
    r"^隱私權政策｜|^建議瀏覽解析度|版權所有$|由.*(?:公司|集團)營運$|^延伸閱讀：|^相關閱讀：",
    r"^本文へ移動|^メニューを開く|^サイト内検索|^ページの先頭へ|^もっと見る|^このページを共有|^印刷｜|^前へ \d|このサイトはクッキーを使います|小さなファイルの保存に同意|^プライバシー設定|^クッキーを許可|^メールマガジン|^メールアドレス 登録|^広告$|^スポンサー|^一部の機能には",
    r"^利用規約｜|無断転載を禁じます$|が運営しています$|^関連：|^この記事を聞く|^\d+ ?/ ?\d+ ?ページ",
    r"^Zum Inhalt springen|^Navigation überspringen|^Menü öffnen|^Seite durchsuchen|^Suche auf|^Nach oben|^Mehr laden|^Seite teilen|^Drucken|^Wir verwenden Cookies|^Mit der Nutzung von|^Datenschutz-Einstellungen|^Jetzt den Rundbrief|^Ihre E-Mail|^Weiter nach der Werbung|^Anzeige$|^Für einige Funktionen",
    r"^Impressum \||Alle Rechte vorbehalten|ist ein Angebot der|^Lesen Sie auch|^Mehr zum Thema:|^Seite anhören|^Siehe auch:",
    r"^Aller au contenu|^Ouvrir le menu|^Rechercher sur|^Haut de page|^Voir plus|^Partager cette page|^Imprimer|^Nous utilisons des cookies|^En poursuivant votre visite|^Gérer mes préférences|^Abonnez-vous|^Votre adresse e-mail|^La suite après|^Publicité$|^Certaines fonctions exigent",
    r"^Mentions légales|Tous droits réservés|est édité par|^À lire aussi ?:|^Lire aussi|^Écouter cette page",
    r"^Saltar al contenido|^Ir al contenido|^Abrir menú|^Buscar en|^Volver arriba|^Cargar más|^Compartir esta página|^Imprimir \||^Usamos cookies|^Al seguir navegando|^Configurar privacidad|^Suscríbase|^Su correo electrónico|^Publicidad$|^Sigue después|^Algunas funciones necesitan",
    r"^Aviso legal|Todos los derechos reservados|es una marca de|^Lea también|^También:|^Escuchar esta página|^Ver también",
)), regex.I)
#: Headings of boxes with other stories.
BOX = regex.compile("^(?:" + "|".join((
    r"Related articles|You may also like|Most read|In this section|More from .+|Popular now|Recommended for you|Trending",
    r"相關文章|猜你喜歡|熱門排行|更多.+內容|本區(?:塊|其他)?.*|同類文章|推薦閱讀",
    r"関連記事|あわせて読みたい|人気の記事|このコーナー.*|.+の(?:他の|ほかの)記事|おすすめ.*|もっと.+|.+からもっと",
    r"Das könnte Sie auch interessieren|Meistgelesen|Mehr von .+|In dieser Rubrik|Verwandte Artikel|Ähnliche Artikel",
    r"À lire aussi|Les plus lus|Dans la même rubrique|Plus (?:sur|de|d['’]|avec) ?.+|Articles liés|Sur le même sujet|Vous aimerez aussi",
    r"También le puede interesar|Lo más leído|Más en .+|En esta sección|Artículos relacionados",
)) + ")$", regex.I)
_LINK = r"\[[^\]\n]*\]\([^)\s]*\)"
_LINKS_ONLY = regex.compile(rf"^(?:[-*•]\s+)?{_LINK}(?:[\s|·•,/]*{_LINK})*$")
_EXPLAINED = regex.compile(rf"^[-*•]\s+{_LINK}\s*[:：–-]\s*\S")
_BULLET = regex.compile(r"^[-*•]\s+")
_PRICE = regex.compile(r"\p{Sc}|\b[A-Z]{3}\b ?\d|\d ?(?:[A-Z]{3}\b|元|円)|[:：] ?[\d.,]+$|\d[\d.,]*$")
_CRUMB = regex.compile(r" > | » | / | › | ＞ ")
_END = regex.compile(r"[.。!?！？…]$")


def _menu_line(s: str) -> bool:
    t = _BULLET.sub("", s)
    if t.lower() in MENU:
        return True
    if s.startswith("|"):
        return False
    parts = [p.strip().lower() for p in regex.split(r"\s*[|｜·•]\s*|\s{2,}|　", t) if p.strip()]
    return len(parts) > 1 and sum(p in MENU for p in parts) * 2 > len(parts)


def labels(lines: list[str]) -> list[bool | None]:
    """True for site furniture, False for the main body, None for blank lines."""
    out: list[bool | None] = []
    fence = box = False
    for line in lines:
        s = line.strip()
        if not s:
            out.append(None)
            box = False
            continue
        if s.startswith(("```", "~~~")):
            fence, box = not fence, False
            out.append(False)
            continue
        if fence:
            out.append(False)
            continue
        head = s.lstrip("#*").rstrip("*").strip()
        plain = s.startswith(("#", "**")) or not _END.search(s)
        crumbs = _CRUMB.split(s)
        if FURNITURE.search(s) or _menu_line(s) or (len(crumbs) > 1 and crumbs[0].strip().lower() in MENU):
            out.append(True)
        elif plain and BOX.match(head):
            box = True
            out.append(True)
        elif _EXPLAINED.match(s):
            box = False
            out.append(False)
        elif _LINKS_ONLY.match(s):
            out.append(True)
        elif box and not s.startswith(("#", "|")) and not _END.search(s) and not _PRICE.search(s):
            out.append(True)
        else:
            box = False
            out.append(False)
    return out
