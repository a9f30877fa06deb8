"""Head keys and where their values go: `key>path` words by the first part of the path. A star collects all values, | parts several paths, / begins a whole one."""

from __future__ import annotations


def paths(groups: dict[str, str]) -> dict[str, str]:
    out = {}
    for first, words in groups.items():
        for word in words.split():
            key, _, to = word.partition(">")
            out[key] = "|".join(p[1:] if p.startswith("/") else f"{first}.{p}" if first else p for p in to.split("|"))
    return out


NAMES = paths(
    {
        "": "yandex>yandex version>version topic>topic theme-color>theme_color theme>theme target>target supported-color-schemes>supported_color_schemes summary>summary subject>subject slurp>slurp revisit-after>revisit_after revision>revision reply-to>reply_to rating>rating publisher>publisher payment-pointer>payment_pointer owner>owner origin-trial>origin_trial* monetization>monetization mobile-web-app-capable>mobile_web_app_capable language>language keywords>keywords identifier-url>identifier_url icbm>icbm ia_archiver>ia_archiver googlebot-video>googlebot_video googlebot-news>googlebot_news googlebot-image>googlebot_image googlebot>googlebot go-import>go_import generator>generator duckduckbot>duckduckbot distribution>distribution designer>designer description>description csrf-token>csrf_token csrf-param>csrf_param creator>creator copyright>copyright contact>contact color-scheme>color_scheme classification>classification category>category build>build bitcoin>bitcoin bingbot>bingbot baiduspider>baiduspider author>author audience>audience application-url>application_url application-name>application_name amp-google-client-id-api>amp_google_client_id_api abstract>abstract",
        "amp_experiments_opt_in|amp": "amp-experiments-opt-in>/amp_experiments_opt_in|/amp.experiments_opt_in",
        "apple": "apple-touch-startup-image>touch_startup_image apple-touch-icon-title>touch_icon_title apple-touch-fullscreen>touch_fullscreen apple-mobile-web-app-title>mobile_web_app_title apple-mobile-web-app-status-bar-style>mobile_web_app_status_bar_style apple-mobile-web-app-orientations>mobile_web_app_orientations apple-mobile-web-app-capable>mobile_web_app_capable apple-itunes-app>itunes_app",
        "citation": "citation_volume>volume citation_title>title citation_technical_report_number>technical_report_number citation_technical_report_institution>technical_report_institution citation_publisher>publisher citation_publication_date>publication_date citation_pdf_url>pdf_url citation_lastpage>lastpage citation_language>language citation_keywords>keywords citation_journal_title>journal_title citation_journal_abbrev>journal_abbrev citation_issue>issue citation_issn>issn citation_isbn>isbn citation_fulltext_html_url>fulltext_html_url citation_firstpage>firstpage citation_doi>doi citation_dissertation_institution>dissertation_institution citation_date>date citation_conference_title>conference_title citation_author_institution>author_institution* citation_author_email>author_email* citation_author>author*",
        "dc": "dc.type>type dc.title>title dc.subject>subject dc.source>source dc.rights>rights dc.relation>relation dc.publisher>publisher dc.language>language dc.identifier>identifier dc.format>format dc.description>description dc.date>date dc.creator>creator dc.coverage>coverage dc.contributor>contributor",
        "dcterms": "dcterms.valid>valid dcterms.temporal>temporal dcterms.tableofcontents>table_of_contents dcterms.spatial>spatial dcterms.rightsholder>rights_holder dcterms.requires>requires dcterms.replaces>replaces dcterms.references>references dcterms.provenance>provenance dcterms.modified>modified dcterms.medium>medium dcterms.mediator>mediator dcterms.license>license dcterms.isversionof>is_version_of dcterms.issued>issued dcterms.isrequiredby>is_required_by dcterms.isreplacedby>is_replaced_by dcterms.isreferencedby>is_referenced_by dcterms.ispartof>is_part_of dcterms.isformatof>is_format_of dcterms.instructionalmethod>instructional_method dcterms.hasversion>has_version dcterms.haspart>has_part dcterms.hasformat>has_format dcterms.extent>extent dcterms.educationlevel>education_level dcterms.datesubmitted>date_submitted dcterms.datecopyrighted>date_copyrighted dcterms.dateaccepted>date_accepted dcterms.created>created dcterms.conformsto>conforms_to dcterms.bibliographiccitation>bibliographic_citation dcterms.available>available dcterms.audience>audience dcterms.alternative>alternative dcterms.accrualpolicy>accrual_policy dcterms.accrualperiodicity>accrual_periodicity dcterms.accrualmethod>accrual_method dcterms.accessrights>access_rights dcterms.abstract>abstract",
        "experimental": "view-transition>view_transition turbo-visit-control>turbo_visit_control turbo-cache-control>turbo_cache_control darkreader-lock>darkreader_lock",
        "geo": "geo.region>region geo.position>position geo.placename>placename geo.lmk>lmk geo.country>country geo.a3>a3 geo.a2>a2 geo.a1>a1",
        "google": "google-translate-customization>translate_customization google-play-app>play_app google-adsense-account>adsense_account",
        "handheld_friendly|mobile": "handheldfriendly>/handheld_friendly|/mobile.handheld_friendly|/legacy.handheld_friendly",
        "legacy": "resource-type>resource_type page-version>page_version imagetoolbar>imagetoolbar doc-type>doc_type doc-rights>doc_rights doc-class>doc_class",
        "mobile": "x5-page-mode>x5_page_mode x5-orientation>x5_orientation x5-fullscreen>x5_fullscreen screen-orientation>screen_orientation mobile-agent>mobile_agent layoutmode>layoutmode imagemode>imagemode full-screen>full_screen browsermode>browsermode",
        "mobile_optimized|mobile": "mobileoptimized>/mobile_optimized|/mobile.mobile_optimized|/legacy.mobile_optimized",
        "msapplication": "mssmarttagspreventparsing>smart_tags_prevent_parsing|/legacy.ms_smart_tags_prevent_parsing msapplication-window>window msapplication-wide310x150logo>wide310x150logo msapplication-tooltip>tooltip msapplication-tileimage>tile_image msapplication-tilecolor>tile_color msapplication-task-separator>task_separator msapplication-task>task* msapplication-tap-highlight>tap_highlight msapplication-starturl>starturl msapplication-square70x70logo>square70x70logo msapplication-square310x310logo>square310x310logo msapplication-square150x150logo>square150x150logo msapplication-notification>notification msapplication-navbutton-color>navbutton_color msapplication-config>config|config_file msapplication-badge>badge msapplication-allowdomainmetatags>allow_domain_meta_tags msapplication-allowdomainapicalls>allow_domain_api_calls ie_rm_off>ie_rm_off",
        "pinterest": "pinterest-rich-pin>rich_pin pinterest>nopin",
        "twitter": "twitter:widgets:new-embed-design>widgets_new_embed_design twitter:widgets:csp>widgets_csp twitter:url>url twitter:title>title twitter:site:id>site_id twitter:site>site twitter:player:width>player_width twitter:player:stream:content_type>player_stream_content_type twitter:player:stream>player_stream twitter:player:height>player_height twitter:player>player twitter:label2>label2 twitter:label1>label1 twitter:image:width>image_width twitter:image:src>image_src twitter:image:height>image_height twitter:image:alt>image_alt twitter:image>image twitter:domain>domain twitter:dnt>dnt twitter:description>description twitter:data2>data2 twitter:data1>data1 twitter:creator:id>creator_id twitter:creator>creator twitter:card>card twitter:app:url:iphone>app_url_iphone twitter:app:url:ipad>app_url_ipad twitter:app:url:googleplay>app_url_googleplay twitter:app:name:iphone>app_name_iphone twitter:app:name:ipad>app_name_ipad twitter:app:name:googleplay>app_name_googleplay twitter:app:id:iphone>app_id_iphone twitter:app:id:ipad>app_id_ipad twitter:app:id:googleplay>app_id_googleplay twitter:app:country>app_country",
        "verification": "zoho-verification>zoho yandex-verification>yandex wot-verification>wot shopify-checkout-api-token>shopify seznam-wmt>seznam p:domain_verify>pinterest norton-safeweb-site-verification>norton naver-site-verification>naver msvalidate.01>bing google-site-verification>google facebook-domain-verification>facebook detectify-verification>detectify brave-rewards-verification>brave baidu-site-verification>baidu alexaverifyid>alexa ahrefs-site-verification>ahrefs",
        "wiki": "resourceloaderdynamicstyles>resource_loader_dynamic_styles",
    }
)
PROPERTIES = paths(
    {
        "fb": "fb:pages>pages* fb:app_id>app_id fb:admins>admins*",
        "fediverse": "fediverse:creator>creator",
        "og": "video:writer>video_ns.writer* video:tag>video_ns.tag* video:series>video_ns.series video:release_date>video_ns.release_date video:duration>video_ns.duration video:director>video_ns.director* video:actor:role>video_ns.actor_role video:actor>video_ns.actor* profile:username>profile.username profile:last_name>profile.last_name profile:gender>profile.gender profile:first_name>profile.first_name og:video:width>video_width og:video:url>video_url og:video:type>video_type og:video:secure_url>video_secure_url og:video:height>video_height og:video:alt>video_alt og:video>video* og:url>url og:type>type og:title>title og:site_name>site_name og:locale:alternate>locale_alternate* og:locale>locale og:image:width>image_width og:image:url>image_url og:image:type>image_type og:image:secure_url>image_secure_url og:image:height>image_height og:image:alt>image_alt og:image>image* og:determiner>determiner og:description>description og:audio:url>audio_url og:audio:type>audio_type og:audio:secure_url>audio_secure_url og:audio>audio* music:song:track>music.song_track music:song:disc>music.song_disc music:song>music.song* music:release_date>music.release_date music:musician>music.musician* music:duration>music.duration music:creator>music.creator* music:album:track>music.album_track music:album:disc>music.album_disc music:album>music.album* book:tag>book.tag* book:release_date>book.release_date book:isbn>book.isbn book:author>book.author* article:tag>article.tag* article:section>article.section article:publisher>article.publisher article:published_time>article.published_time article:modified_time>article.modified_time article:expiration_time>article.expiration_time article:author>article.author*",
    }
)
EQUIV = paths(
    {
        "http_equiv": "x-ua-compatible>x_ua_compatible x-dns-prefetch-control>x_dns_prefetch_control window-target>window_target set-cookie>set_cookie refresh>refresh pragma>pragma permissions-policy>permissions_policy|permissions_policy_value origin-trial>origin_trial*|origin_trial_token* imagetoolbar>imagetoolbar expires>expires delegate-ch>delegate_ch default-style>default_style content-type>content_type content-security-policy-report-only>content_security_policy_report_only content-security-policy>content_security_policy content-language>content_language cleartype>cleartype|/msapplication.cleartype cache-control>cache_control accept-ch>accept_ch",
    }
)
ITEMPROPS = paths(
    {
        "itemprop": "name>name image>image description>description",
    }
)
#: Relations: = keeps the address, 1 the first link, * all links, # all that name sizes.
RELS = {
    "=": "working-copy-of>working_copy_of working-copy>working_copy webmention via version-history>version_history up token_endpoint timemap timegate terms-of-service>terms_of_service sunset successor-version>successor_version status start shortlink shortcut+icon>shortcut_icon serviceworker service-meta>service_meta service-doc>service_doc service-desc>service_desc service self security.txt>security_txt publisher privacy-policy>privacy_policy previous prev predecessor-version>predecessor_version pingback payment openid2.provider>openid2_provider openid2.local_id>openid2_local_id openid.server>openid_server openid.delegate>openid_delegate next microsub micropub memento manifest lrdd license latest-version>latest_version last indieauth-metadata>indieauth_metadata index image_src hub hosts help glossary gbfs first edituri>edit_uri dpp disclosure describes describedby deprecation copyright contents compression-dictionary>compression_dictionary cite-as>cite_as canonical c2pa-manifest>c2pa_manifest bookmark authorization_endpoint author api-catalog>api_catalog amphtml",
    "1": "search mask-icon>mask_icon icon fluid-icon>fluid_icon apple-touch-icon>apple_touch_icon",
    "*": "ugc tag syndication subsection stylesheet sponsored section related profile prerender preload prefetch preconnect opener noreferrer noopener nofollow modulepreload me external expect enclosure dns-prefetch>dns_prefetch chapter archives apple-touch-startup-image>apple_touch_startup_image apple-touch-icon-precomposed>apple_touch_icon_precomposed appendix alternate>alternate_hreflang",
    "#": "",
}
RELATIONS = {k.replace("+", " "): (p or k, kind) for kind, words in RELS.items() for k, _, p in (w.partition(">") for w in words.split())}
