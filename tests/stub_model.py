"""A deterministic stand-in for a user's model."""


class EchoModel:
    """Answers with the last ``Input:`` text of the prompt, cut to
    ``max_tokens`` words, then an end-of-text marker and a repeated example,
    like a small model would.  Prompts of an odd length are echoed in front of
    the answer, as a decoder that returns prompt plus continuation does."""

    def generate(self, prompts, max_tokens, temperature, top_k):
        outs = []
        for p in prompts:
            text = p.rsplit("Input: ", 1)[-1].rsplit("\nOutput:", 1)[0]
            answer = " " + " ".join(text.split(" ")[:max_tokens]) + "<|endoftext|>\nInput: again"
            outs.append(p + answer if len(p) % 2 else answer)
        return outs


def load_echo_model():
    return EchoModel()


class CountingModel:
    """Answers with the size of the batch and what the batch costs."""

    def generate(self, prompts, max_tokens, temperature, top_k):
        cost = sum(len(p.split()) + max_tokens for p in prompts)
        return [f"{len(prompts)} {cost} {top_k}" for _ in prompts]


def load_counting_model():
    return CountingModel()
