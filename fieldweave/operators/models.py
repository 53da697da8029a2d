"""Adapters for models that aren't part of this package: a hosted chat model over HTTP, and a sentence model in a local folder."""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

from fieldweave.errors import ProcessingError
from fieldweave.operators import concepts

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ChatModel:
    """A model behind an endpoint that takes `messages` and answers with `choices` or `content`. It holds settings only, so it can be sent to executors."""

    url: str
    model: str
    key: str = ""
    max_tokens: int = 4096
    timeout: float = 120.0
    tries: int = 3

    def ask(self, system: str, user: str) -> str:
        """The answer's text. A busy or failing endpoint is asked again, after ever longer waits; refusals and bad answers are errors at once."""
        said = {"model": self.model, "max_tokens": self.max_tokens, "temperature": 0, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        request = urllib.request.Request(self.url, json.dumps(said).encode(), {"content-type": "application/json", **({"authorization": f"Bearer {self.key}"} if self.key else {})})
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return self._text(json.load(answer))
            except urllib.error.HTTPError as e:
                if not left or e.code not in (408, 429) and e.code < 500:
                    raise ProcessingError("MODEL_CALL_FAILED", f"the model's endpoint answered {e.code}", {"url": self.url}, e) from e
            except (OSError, ValueError) as e:
                if not left:
                    raise ProcessingError("MODEL_CALL_FAILED", "the model's endpoint can't be used", {"url": self.url}, e) from e
            time.sleep(2.0 ** (self.tries - left) / 4)
        raise ProcessingError("MODEL_CALL_FAILED", "no tries were allowed", {"url": self.url})

    @staticmethod
    def _text(answer: dict) -> str:
        try:
            return answer["choices"][0]["message"]["content"] if "choices" in answer else "".join(part.get("text", "") for part in answer["content"])
        except (KeyError, IndexError, TypeError, AttributeError) as e:
            raise ProcessingError("MODEL_ANSWER_UNKNOWN", "the answer has neither choices nor content", {"keys": sorted(answer) if isinstance(answer, dict) else []}, e) from e


@dataclass(frozen=True)
class ChatClusterer:
    """A chat model as a clusterer of fields."""

    model: ChatModel

    def __call__(self, lines: list[str], event_types: list[str]) -> str:
        return self.model.ask(concepts.INSTRUCTIONS, concepts.prompt(lines, event_types))


@dataclass(frozen=True)
class ChatAdviser:
    """A chat model as an adviser on a review's issues."""

    model: ChatModel

    def __call__(self, text: str) -> str:
        return self.model.ask("You review data schemas. Turn issues into recommendations. Answer with JSON only.", text)


@lru_cache(maxsize=2)
def _sentence_model(folder: str):
    import onnxruntime
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(Path(folder) / "tokenizer.json"))
    tokenizer.enable_truncation(256)
    tokenizer.enable_padding()
    return tokenizer, onnxruntime.InferenceSession(str(Path(folder) / "model.onnx"), providers=["CPUExecutionProvider"])


@dataclass(frozen=True)
class SentenceEmbedder:
    """Unit vectors from a sentence model, `model.onnx` and `tokenizer.json` in a folder that every executor has: the mean of its token vectors."""

    folder: str
    batch: int = 32

    def __call__(self, texts: list[str]) -> np.ndarray:
        tokenizer, session = _sentence_model(self.folder)
        wanted = {x.name for x in session.get_inputs()}
        out = []
        for i in range(0, len(texts), self.batch):
            coded = tokenizer.encode_batch([t or "" for t in texts[i : i + self.batch]])
            mask = np.array([c.attention_mask for c in coded], np.int64)
            fed = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.array([c.type_ids for c in coded], np.int64)}
            vectors = session.run(None, {k: v for k, v in fed.items() if k in wanted})[0]
            mean = (vectors * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
            out.append(mean / np.maximum(np.linalg.norm(mean, axis=1), 1e-12)[:, None])
        return np.concatenate(out).astype(np.float32) if out else np.zeros((0, 0), np.float32)
