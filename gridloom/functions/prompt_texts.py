"""The texts of the prompt versions, which models were trained on word for word."""

PRIORS = "The transformations are always based on the following priors: objectness, goal-directed, numbers & counting, and basic geometry & topology.\n"
ARC = "Let's see if you can solve this simple Abstraction and Reasoning Challenge (ARC) task.\nBelow there are some input-output grid examples that define the task.\n"

SYSTEM_LONG = """You are a helpful AI assistant. Your job is to solve tasks from the Abstraction and Reasoning Challenge (ARC). 
The user will present you with sample input and output grids for each task. 
Your job will be to understand the transformation between the input and the output and apply it to the last input grid given by the user. 
The puzzle-like inputs and outputs present a grid where each square can be one of ten colors. A grid can be any height or width between 1x1 and 30x30.
The background of the grid is typically colored with 0.
The tasks from ARC are based on the following priors:

- Objectness: Objects persist and cannot appear or disappear without reason. Objects can interact or not depending on the circumstances.
- Goal-directed: Objects can be animate or inanimate. Some objects are "agents" - they have intentions and they pursue goals.
- Numbers & counting: Objects can be counted or sorted by their shape, appearance, or movement using basic mathematics like addition, subtraction, and comparison.
- Basic geometry & topology: Objects can be shapes like rectangles, triangles, and circles which can be mirrored, rotated, translated, deformed, combined, repeated, etc. Differences in distances can be detected.

The transformations between input and output should be based on these priors.
"""
SYSTEM_SHORT = "You are a helpful assistant."

SOLVE_FIRST = "Let's see if you can solve this simple ARC task. These are some input-output grid examples that define the task.\n"
SOLVE = ARC + "Your job is to understand the transformation between the input and the output and apply it to the test input grid.\n" + PRIORS
NEW_GRID = """Your task is to create a new grid that follows the same distribution as the input grids from the Abstraction and Reasoning Challenge (ARC).
Below there are some grid examples, please create a new and different grid that follows the same distribution.
"""
WRITE_CODE = ARC + "Your job is to understand the transformation between the input and the output and write a python function that implements the transformation.\nThe function should be called `task` and receives a numpy array called `grid` as input.\n" + PRIORS
GENERATE = """You are tasked with solving a transformation problem from the Abstraction and Reasoning Challenge (ARC).
The goal is to generate a Python function called `task` that receives a 2D numpy array, `grid`, and transforms it to match the desired output.

Below are several input-output examples that illustrate the transformation. Your function should generalize the pattern from these examples to solve any input following the same logic.

## Key Priors:

- **Objectness**: Consider the grid as containing objects (groups of connected cells) rather than just individual pixels.
- **Goal-Directed**: The transformation should achieve a specific goal, such as creating symmetry or changing the color of specific objects.
- **Numbers & Counting**: Keep track of the number of objects, sizes, and their relative positions.
- **Geometry & Topology**: Use spatial relationships such as adjacency, enclosure, or symmetry.

Carefully analyze the examples and find the underlying transformation logic.

## Examples
"""
GENERATE_IMG = GENERATE.replace("`grid`", "`img`")
RUN_CODE = "Your task is to transform the input grid using the transformation defined in the python code below.\n"
SELECT = ARC + "Your job is to understand the transformation between the input and the output and select the correct test output grid.\nJust reply with the index of the correct test output option.\n" + PRIORS
VERIFY = """Let's see if you can verify the output for an Abstraction and Reasoning Challenge (ARC) task.
Below there are some input-output grid examples that define the task.
Your job is to understand the transformation between the input and the output and verify if the test output grid is correct.
Just reply with the word "yes" if the test output is correct or "no" if it is not.
""" + PRIORS

CODE_TAIL = "\n## Code\n\nImplement the transformation in Python."
VERIFY_TAIL = "\n\nIs the test output correct?"
ANSWER_OUTPUT = "### Output\n\n"
ANSWER_NEW_GRID = "## New grid\n\n"
ANSWER_CODE = "## Code\n\nThis is the Python function that implements the transformation logic:\n\n"
