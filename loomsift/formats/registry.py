"""File name to MIME type to handler, and one entry point each for reading and cleaning."""

from __future__ import annotations

import signal
import threading
from contextlib import contextmanager

from ..options import Options
from .errors import FormatError, TooLarge, Unsupported
from .fixed import HANDLERS, MIME_OF, SUPPORTED  # noqa: F401

HANDLER_OF = {mime: h for h, mimes in HANDLERS.items() for mime in mimes}
OTHER = "application/octet-stream"


def mime_of(name: str) -> str:
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    stem, dot, ext = base.rpartition(".")
    return MIME_OF.get(ext.lower(), OTHER) if dot and stem else OTHER


def handler_of(mime: str) -> str | None:
    return HANDLER_OF.get(mime)


@contextmanager
def _time_limit(seconds: float | None):
    """Interrupts Python code on the main thread of a worker; elsewhere there is no limit."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise FormatError(f"stopped after {seconds:g} s")

    old = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def _parts(handler: str):
    from . import archive, audio, office, pdf, raster, svg, torrent, video, web

    return {
        "html": (web.read_html, web.clean_html),
        "css": (web.read_css, web.clean_css),
        "svg": (svg.read_svg, svg.clean_svg),
        "torrent": (torrent.read_torrent, torrent.clean_torrent),
        "gif": (raster.read_gif, raster.clean_gif),
        "image": (raster.read_image, raster.clean_image),
        "harmless": (raster.read_harmless, raster.clean_harmless),
        "pdf": (pdf.read_pdf, pdf.clean_pdf),
        "audio": (audio.read_audio, audio.clean_audio),
        "video": (video.read_video, video.clean_video),
        "document": (office.read_office, office.clean_office),
        "archive": (archive.read_archive, archive.clean_archive),
    }[handler]


def _route(body: bytes | None, name: str, mime: str, o: Options) -> str:
    if body is None:
        raise FormatError("no body")
    if o.input_cap is not None and len(body) > o.input_cap:
        raise TooLarge(f"{len(body)} bytes, the limit is {o.input_cap}")
    handler = handler_of(mime)
    if handler is None:
        raise Unsupported(f"no handler for {mime}")
    return handler


def read_groups(body: bytes | None, name: str, mime: str, o: Options) -> list[tuple[str, list[tuple[str, str]]]]:
    handler = _route(body, name, mime, o)
    got = _parts(handler)[0](body, name=name, mime=mime, options=o, extended=o.extended)
    return got if handler in ("archive", "document") else [(name, got)]


def clean_body(body: bytes | None, name: str, mime: str, o: Options) -> bytes:
    return _parts(_route(body, name, mime, o))[1](body, name=name, mime=mime, options=o)


def safely(f, body: bytes | None, name: str, mime: str, o: Options) -> tuple:
    """(result, error class, error): whatever a file does, its row comes back."""
    try:
        with _time_limit(o.timeout_s):
            return f(body, name, mime, o), None, None
    except FormatError as e:
        return None, e.kind, str(e)
    except RecursionError:
        return None, "ParseError", "nested too deeply"
    except Exception as e:
        return None, "HandlerPanicked", f"{type(e).__name__}: {e}"
