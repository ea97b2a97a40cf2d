"""A stand-in for a model: asks the calculator once, then answers 1."""


def knows_nothing(body):
    if body["messages"][-1]["role"] == "tool":
        return {"message": {"content": "*Final answer*: 1"}, "eval_count": 3}
    call = {"function": {"name": "calculator", "arguments": {"operand_1": 1, "operand_2": 0, "operator": "add"}}}
    return {"message": {"content": "", "tool_calls": [call]}, "eval_count": 5}
