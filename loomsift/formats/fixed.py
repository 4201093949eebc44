"""Names, keys and types of the file formats that readers and cleaners go by. No logic."""

# ---- Fixed values ----

#: handler: MIME types it takes.
HANDLERS: dict[str, list[str]] = {
    "image": ["image/jpeg", "image/png", "image/webp", "image/tiff", "image/heic", "image/heif", "image/jxl"],
    "gif": ["image/gif"],
    "pdf": ["application/pdf"],
    "audio": [
        "audio/mpeg", "audio/flac", "audio/ogg", "audio/vorbis", "audio/mp4", "audio/x-wav", "audio/wav", "audio/aac", "audio/x-aiff", "audio/x-flac", "audio/x-m4a", "audio/m4a", "audio/aiff", "audio/opus",
    ],
    "document": [
        "application/vnd.oasis.opendocument.text",
        "application/vnd.oasis.opendocument.spreadsheet",
        "application/vnd.oasis.opendocument.presentation",
        "application/vnd.oasis.opendocument.graphics",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "application/epub+zip",
    ],
    "video": ["video/mp4", "video/x-matroska", "video/webm", "video/x-msvideo", "video/avi", "video/quicktime", "video/x-ms-wmv", "video/x-flv", "video/ogg"],
    "harmless": ["text/plain", "image/bmp", "image/x-ms-bmp", "image/x-portable-pixmap", "image/x-portable-graymap", "image/x-portable-bitmap", "image/x-portable-anymap"],
    "svg": ["image/svg+xml"],
    "css": ["text/css"],
    "html": ["text/html", "application/xhtml+xml"],
    "torrent": ["application/x-bittorrent"],
    "archive": [
        "application/zip", "application/x-tar", "application/gzip", "application/x-gzip", "application/x-compressed", "application/x-bzip2", "application/x-bzip-compressed-tar", "application/x-gtar",
        "application/x-xz", "application/zstd", "application/x-zstd",
    ],
}

#: The last extension, lower-cased, to MIME type.
MIME_OF = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "jpe": "image/jpeg",
    "png": "image/png",
    "webp": "image/webp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "heic": "image/heic",
    "heif": "image/heif",
    "gif": "image/gif",
    "jxl": "image/jxl",
    "pdf": "application/pdf",
    "mp3": "audio/mpeg",
    "flac": "audio/flac",
    "ogg": "audio/ogg",
    "oga": "audio/ogg",
    "opus": "audio/opus",
    "wav": "audio/wav",
    "m4a": "audio/m4a",
    "aac": "audio/aac",
    "aiff": "audio/aiff",
    "aif": "audio/aiff",
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "odg": "application/vnd.oasis.opendocument.graphics",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "epub": "application/epub+zip",
    "mp4": "video/mp4",
    "m4v": "video/mp4",
    "mkv": "video/x-matroska",
    "webm": "video/webm",
    "avi": "video/x-msvideo",
    "mov": "video/quicktime",
    "qt": "video/quicktime",
    "wmv": "video/x-ms-wmv",
    "flv": "video/x-flv",
    "ogv": "video/ogg",
    "txt": "text/plain",
    "text": "text/plain",
    "log": "text/plain",
    "bmp": "image/bmp",
    "ppm": "image/x-portable-pixmap",
    "pgm": "image/x-portable-graymap",
    "pbm": "image/x-portable-bitmap",
    "pnm": "image/x-portable-anymap",
    "svg": "image/svg+xml",
    "css": "text/css",
    "html": "text/html",
    "htm": "text/html",
    "xhtml": "application/xhtml+xml",
    "xht": "application/xhtml+xml",
    "torrent": "application/x-bittorrent",
    "zip": "application/zip",
    "tar": "application/x-tar",
    "gz": "application/gzip",
    "tgz": "application/gzip",
    "bz2": "application/x-bzip2",
    "tbz": "application/x-bzip2",
    "tbz2": "application/x-bzip2",
    "xz": "application/x-xz",
    "txz": "application/x-xz",
    "zst": "application/zstd",
    "tzst": "application/zstd",
    "json": "application/json",
    "xml": "text/xml",
    "js": "text/javascript",
    "csv": "text/csv",
    "md": "text/markdown",
}

#: Extensions that are read and cleaned; compressed tars are listed by all their suffixes.
SUPPORTED = [
    "jpg", "jpeg", "png", "webp", "tif", "tiff", "heic", "heif", "gif", "jxl",
    "pdf",
    "mp3", "flac", "ogg", "opus", "wav", "m4a", "aac", "aiff",
    "odt", "ods", "odp", "odg", "docx", "xlsx", "pptx", "epub",
    "mp4", "mkv", "webm", "avi", "mov", "wmv", "flv",
    "txt", "bmp", "ppm", "pgm", "pbm", "pnm",
    "svg", "css", "html", "htm", "xhtml",
    "torrent",
    "zip", "tar", "tar.gz", "tgz", "tar.bz2", "tbz2", "tar.xz", "txz", "tar.zst", "tzst",
]

#: Archive suffix to format.
ARCHIVE_SUFFIXES = {
    ".tar.gz": "tar.gz", ".tgz": "tar.gz", ".tar.bz2": "tar.bz2", ".tbz2": "tar.bz2", ".tbz": "tar.bz2", ".tar.xz": "tar.xz", ".txz": "tar.xz", ".tar.zst": "tar.zst", ".tzst": "tar.zst", ".tar": "tar", ".zip": "zip",
}
#: Suffixes of plain compressed files, which are no archives.
PLAIN_SUFFIXES = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz", ".zst": "zstd"}

# HTML
HTML_RAW_TEXT = ["script", "style", "textarea", "title"]
HTML_DROP = ["meta", "link", "base", "script", "style", "noscript", "iframe", "object", "embed"]
HTML_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
#: Attributes that name a meta element.
HTML_META_NAMES = ["name", "http-equiv", "property", "itemprop"]

# SVG
SVG_DROP = ["metadata", "title", "desc", "namedview", "script", "style", "foreignObject", "iframe"]
SVG_PREFIXES = ["inkscape:", "sodipodi:", "rdf:", "dc:", "cc:"]
SVG_EVENTS = [
    "onabort", "onactivate", "onafterprint", "onanimationend", "onanimationiteration", "onanimationstart", "onauxclick", "onbeforeinput", "onbeforeprint", "onbeforeunload", "onbegin", "onblur",
    "oncancel", "oncanplay", "oncanplaythrough", "onchange", "onclick", "onclose", "oncontextlost", "oncontextmenu", "oncontextrestored", "oncopy", "oncuechange", "oncut",
    "ondblclick", "ondrag", "ondragend", "ondragenter", "ondragleave", "ondragover", "ondragstart", "ondrop", "ondurationchange",
    "onemptied", "onend", "onended", "onerror", "onfocus", "onfocusin", "onfocusout", "onformdata", "ongotpointercapture", "onhashchange", "oninput", "oninvalid",
    "onkeydown", "onkeypress", "onkeyup", "onlanguagechange", "onload", "onloadeddata", "onloadedmetadata", "onloadstart", "onlostpointercapture",
    "onmessage", "onmessageerror", "onmousedown", "onmouseenter", "onmouseleave", "onmousemove", "onmouseout", "onmouseover", "onmouseup",
    "onoffline", "ononline", "onpagehide", "onpageshow", "onpaste", "onpause", "onplay", "onplaying",
    "onpointercancel", "onpointerdown", "onpointerenter", "onpointerleave", "onpointermove", "onpointerout", "onpointerover", "onpointerup", "onpopstate", "onprogress",
    "onratechange", "onrejectionhandled", "onrepeat", "onreset", "onresize", "onscroll", "onscrollend", "onsecuritypolicyviolation", "onseeked", "onseeking", "onselect", "onshow", "onslotchange",
    "onstalled", "onstorage", "onsubmit", "onsuspend", "ontimeupdate", "ontoggle", "ontransitionend", "ontransitionstart", "onunhandledrejection", "onunload", "onvolumechange", "onwaiting", "onwheel", "onzoom",
]

# Torrent: top-level keys that stay
TORRENT_KEEP = [b"announce", b"announce-list", b"info"]

# PNG chunks that carry metadata
PNG_DROP = [b"tEXt", b"iTXt", b"zTXt", b"tIME", b"eXIf", b"iCCP"]

# XMP namespaces that are read
XMP_PREFIXES = ["dc", "xmp", "xmpMM", "xmpRights", "pdf", "pdfx", "photoshop", "Iptc4xmpCore", "aux", "cc", "exif", "tiff", "crs", "stEvt", "stRef", "lr", "plus"]

# IPTC: datasets of record 2
IPTC_NAMES = {
    5: "Object Name",
    10: "Urgency",
    15: "Category",
    20: "Supplemental Categories",
    22: "Fixture Identifier",
    25: "Keywords",
    40: "Special Instructions",
    55: "Date Created",
    60: "Time Created",
    62: "Digital Creation Date",
    63: "Digital Creation Time",
    65: "Originating Program",
    70: "Program Version",
    80: "By-line",
    85: "By-line Title",
    90: "City",
    92: "Sub-location",
    95: "Province / State",
    100: "Country Code",
    101: "Country",
    103: "Original Transmission Reference",
    105: "Headline",
    110: "Credit",
    115: "Source",
    116: "Copyright Notice",
    118: "Contact",
    120: "Caption",
    122: "Writer / Editor",
    130: "Image Type",
    131: "Image Orientation",
    135: "Language Identifier",
}

# PDF
PDF_INFO = ["Author", "Title", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped"]
PDF_CATALOG = [
    "Metadata", "OpenAction", "AA", "AcroForm", "StructTreeRoot", "MarkInfo", "PieceInfo", "PageLabels", "Outlines", "Threads", "SpiderInfo", "Perms", "Legal", "Requirements", "Collection", "Lang", "URI", "NeedsRendering",
]
#: Catalog keys that are reported, and how.
PDF_ADVICE = {
    "OpenAction": "OpenAction (may run script on open)",
    "AA": "Additional actions",
    "AcroForm": "Form fields / signatures",
    "StructTreeRoot": "Accessibility structure tree",
    "PieceInfo": "Producer-specific piece info",
    "Outlines": "Outline / bookmarks",
    "PageLabels": "Page labels",
    "Perms": "Usage permissions",
}
PDF_NAMES = ["EmbeddedFiles", "JavaScript", "AP", "AlternatePresentations", "Renditions"]
PDF_PAGE = ["Metadata", "Annots", "PieceInfo", "UserUnit", "ID", "AA", "B"]
PDF_XOBJECT = ["Metadata", "PieceInfo", "OPI", "LastModified"]

# Office packages
OFFICE_TEXTS = [
    "creator", "title", "subject", "description", "keywords", "lastModifiedBy", "created", "modified", "revision", "category", "Application", "AppVersion", "Company", "Manager", "TotalTime", "Pages", "Words", "Characters",
    "Paragraphs", "Lines", "initial-creator", "creation-date", "date", "editing-cycles", "editing-duration", "generator", "language", "print-date", "printed-by", "identifier", "rights", "publisher", "contributor",
]
OFFICE_PARTS = ["docProps/core.xml", "docProps/app.xml", "docProps/custom.xml", "meta.xml", "content.opf", "OEBPS/content.opf", "OPS/content.opf"]
OFFICE_XML = [".xml", ".rels", ".opf", ".ncx", ".xhtml"]
OFFICE_MEDIA = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "svg": "image/svg+xml", "heic": "image/heic", "heif": "image/heif", "jxl": "image/jxl",
}
#: Parts that are left out: paths, beginnings and ends of paths.
JUNK_PATHS = [
    "docProps/custom.xml",
    "word/people.xml", "ppt/people.xml", "xl/people.xml", "word/persons/person.xml", "ppt/persons/person.xml", "xl/persons/person.xml",
    "word/viewProps.xml", "ppt/viewProps.xml", "xl/viewProps.xml", "word/presProps.xml", "ppt/presProps.xml", "xl/presProps.xml", "word/numbering.xml", "ppt/numbering.xml", "xl/numbering.xml",
    "layout-cache", "meta.xml", "iTunesMetadata.plist", "META-INF/calibre_bookmarks.txt",
]
JUNK_BEGINNINGS = [
    "customXml/",
    "word/printerSettings/", "ppt/printerSettings/", "xl/printerSettings/", "word/theme", "ppt/theme", "xl/theme", "word/tags/", "ppt/tags/", "xl/tags/", "word/glossary/", "ppt/glossary/", "xl/glossary/",
    "Thumbnails/", "Configurations2/",
]
JUNK_ENDS = ["webSettings.xml", "docMetadata/LabelInfo.xml"]
#: What replaces the property parts.
OFFICE_STUBS = {
    "docProps/core.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties"/>',
    "docProps/app.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"/>',
    "docProps/custom.xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"/>',
}

# Audio: tag keys of ID3, Vorbis comments, RIFF, MP4 and AIFF by the names they are shown with
AUDIO_NAMES = {
    "TIT2": "Title", "TPE1": "Artist", "TALB": "Album", "TPE2": "Album Artist", "TRCK": "Track Number", "TYER": "Year", "TDRC": "Recording Date", "TCON": "Genre", "COMM": "Comment", "TCOM": "Composer",
    "TPE3": "Conductor", "TENC": "Encoded By", "TSSE": "Encoder", "TCOP": "Copyright", "USLT": "Lyrics", "TPUB": "Publisher", "TPE4": "Remixer", "TPOS": "Disc Number", "TBPM": "BPM",
    "TITLE": "Title", "ARTIST": "Artist", "ALBUM": "Album", "ALBUMARTIST": "Album Artist", "TRACKNUMBER": "Track Number", "DATE": "Recording Date", "YEAR": "Year", "GENRE": "Genre", "COMMENT": "Comment",
    "DESCRIPTION": "Description", "COMPOSER": "Composer", "CONDUCTOR": "Conductor", "COPYRIGHT": "Copyright", "LYRICS": "Lyrics", "PUBLISHER": "Publisher", "DISCNUMBER": "Disc Number", "BPM": "BPM",
    "INAM": "Title", "IART": "Artist", "IPRD": "Album", "ICRD": "Recording Date", "IGNR": "Genre", "ICMT": "Comment", "ISFT": "Encoder", "ICOP": "Copyright", "ITRK": "Track Number",
    "\xa9nam": "Title", "\xa9ART": "Artist", "\xa9alb": "Album", "aART": "Album Artist", "\xa9day": "Recording Date", "\xa9gen": "Genre", "\xa9cmt": "Comment", "\xa9wrt": "Composer", "\xa9too": "Encoder",
    "cprt": "Copyright", "\xa9lyr": "Lyrics", "trkn": "Track Number", "disk": "Disc Number", "tmpo": "BPM", "NAME": "Title", "AUTH": "Artist", "(c) ": "Copyright", "ANNO": "Comment",
}
#: Kinds of embedded pictures, by number.
PICTURE_KINDS = [
    "Other", "Icon", "OtherIcon", "CoverFront", "CoverBack", "Leaflet", "Media", "LeadArtist", "Artist", "Conductor", "Band", "Composer", "Lyricist", "RecordingLocation", "DuringRecording", "DuringPerformance",
    "ScreenCapture", "BrightFish", "Illustration", "BandLogo", "PublisherLogo",
]

#: Keys that tell of a file's structure rather than of its origin.
STRUCTURAL_KEYS = [
    "filename", "format", "dimensions", "width", "height", "duration", "channels", "samplerate", "sample_rate", "bitdepth", "bit_depth", "colorspace", "color_space", "icc", "pages", "page count", "bitrate", "codec", "container",
    "stream", "streams", "has icc profile", "has exif", "has xmp", "embedded images", "archive entries", "encoder", "identifier", "language", "title", "handler_name", "vendor_id", "major_brand", "minor_version", "compatible_brands",
]
